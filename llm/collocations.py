"""Phrase collocations by stripes: each prefix keys an associative counter of its next words.

A-Z is lower-cased, ``[.,;:!?\\x0A-\\x0D]`` ends a piece, words are ``[^\\x20\\x09]+``. A phrase is two or three consecutive
words of one piece; everything is counted per language (null: ``und``), overlaps included.

1. Every task gathers stripes: for a prefix of one word its next words with their counts, and the prefix's total; the empty
   prefix of a language has the total of all its words. A task merges what it holds elementwise before it sends it.
2. Stripes are cut into ``SEGMENTS`` by next word and dealt to buckets, so the stripe of a word that makes up a third of all
   words is no task's alone. A bucket merges its stripes elementwise and keeps what occurs ``least`` times.
3. Stripes of two-word prefixes are gathered for windows whose two pairs are both frequent: no other window can be. The pairs
   are looked up in a Bloom filter of bounded size; what it lets through by mistake falls to the counts.
4. A stripe gives the extensions (candidates), its total the counts of prefixes, its largest entry the subsumption from the
   left; entries turned to their last two words give that from the right. Lookups of parts are joins of frequent phrases.

Words travel as 64-bit hashes of language and word; the text of every frequent word comes back from a dictionary that
the tasks send beside the stripes. Two words of one hash would be counted as one: the dictionary sees it and the job fails.

Nulls: a null text is empty, a null language is ``und``. Ids are not read. Repeated rows count each time. An empty table gives an
empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import binary, bucket_count, column_bytes, group_arrow, map_arrow, saved, sliced
from llm.kernel import LOWER, U, Words, buffers, chunks, mix

SEGMENTS = 64
FILTER_BITS = 1 << 25
_FLUSH = 1 << 19
_SALTS = 64
_TOTAL = U(0)  # the next word that stands for the prefix's total; no word has it as its key
_STRIPES = "bucket int, prefixes binary, nexts binary, counts binary, lang string, words binary"
_NAMES = ["prefixes", "nexts", "counts", "lang", "words"]
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def pieces(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of all texts, and whether each is followed by a word of the same piece."""
    data, at = buffers(texts)
    data = LOWER[data]
    word = ~_GAP[data]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = word[edge]
    stops[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, at)
    breaks = np.cumsum(_BREAK[data])[starts] if len(starts) else starts
    goes_on = np.zeros(len(starts), bool)
    goes_on[:-1] = breaks[1:] == breaks[:-1]
    lasts = first[1:][first[1:] > first[:-1]] - 1
    goes_on[lasts] = False
    return Words(data, starts, ends, first), goes_on


def _lang_key(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode("utf-8", "surrogatepass"), np.uint8)
    own = Words(raw, np.array([0]), np.array([len(raw)]), np.array([0, 1])).hashes(False, 3)
    return mix(own, 40)[0]


def _keyed(part: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, dict[np.uint64, str]]:
    """Words, their keys, whether the next one follows in the piece, each word's language key, and the languages."""
    words, goes_on = pieces(part.column("text"))
    langs = part.column("lang").to_pylist()
    known = {lang: _lang_key(lang) for lang in set(langs)}
    own = np.repeat(np.array([known[x] for x in langs], U), np.diff(words.first))
    keys = np.maximum(mix(words.hashes(False) ^ own, 41), U(1))
    return words, keys, goes_on, own, {k: x for x, k in known.items()}


def pair_key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.maximum(mix(mix(one, 42) + two, 43), U(1))


def merged(prefixes: np.ndarray, nexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stripes added up elementwise, sorted by prefix and next word."""
    if not len(prefixes):
        return prefixes, nexts, counts
    order = np.lexsort((nexts, prefixes))
    prefixes, nexts, counts = prefixes[order], nexts[order], counts[order]
    new = np.ones(len(prefixes), bool)
    new[1:] = (prefixes[1:] != prefixes[:-1]) | (nexts[1:] != nexts[:-1])
    at = np.flatnonzero(new)
    return prefixes[at], nexts[at], np.add.reduceat(counts, at)


class _Held:
    """Stripes and words of a task that were not sent yet."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size, self.spelt = buckets, [], 0, {}

    def add(self, prefixes: np.ndarray, nexts: np.ndarray) -> None:
        self.parts.append((prefixes, nexts, np.ones(len(prefixes), np.int64)))
        self.size += len(prefixes)

    def total(self, keys: np.ndarray) -> None:
        own, n = np.unique(keys, return_counts=True)
        self.parts.append((own, np.full(len(own), _TOTAL), n.astype(np.int64)))
        self.size += len(own)

    def merge(self) -> None:
        self.parts = [merged(*map(np.concatenate, zip(*self.parts)))] if self.parts else []
        self.size = len(self.parts[0][0]) if self.parts else 0
        for lang, (keys, words) in self.spelt.items():
            own, first = np.unique(np.concatenate(keys), return_index=True)
            self.spelt[lang] = ([own], [np.concatenate(words)[first]])

    def send(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        if self.parts:
            prefixes, nexts, counts = self.parts[0]
            bucket = (mix(prefixes ^ mix(nexts % U(SEGMENTS), 44), 45) % U(self.buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")  # stays sorted by prefix inside a bucket
            owners, at = sliced(order, bucket[order])
            columns = [binary([a[order[s:e]].tobytes() for s, e in zip(at, at[1:])]) for a in (prefixes, nexts, counts.astype(np.uint32))]
            if (counts >= 1 << 32).any():
                raise OverflowError("a task holds too many words")
            none = pa.nulls(len(owners))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int32()), *columns, none.cast(pa.string()), none.cast(pa.binary())], names=["bucket", *_NAMES])
        for lang, (keys, words) in self.spelt.items():
            keys, texts = keys[0], words[0]
            bucket = (mix(keys ^ mix(np.full(len(keys), _TOTAL % U(SEGMENTS)), 44), 45) % U(self.buckets)).astype(np.int32)  # where its total goes
            order = np.argsort(bucket, kind="stable")
            owners, at = sliced(order, bucket[order])
            rows = [order[s:e] for s, e in zip(at, at[1:])]
            none = pa.nulls(len(owners)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int32()), binary([keys[r].tobytes() for r in rows]), none, none, pa.array([lang] * len(owners), pa.string()), binary([b" ".join(texts[r]) for r in rows])],
                names=["bucket", *_NAMES],
            )
        self.parts, self.size, self.spelt = [], 0, {}

    def spell(self, keys: np.ndarray, words: Words, rows: np.ndarray, lang: str) -> None:
        raw = words.data.tobytes()
        texts = np.empty(len(rows), object)
        texts[:] = [raw[s:e] for s, e in zip(words.starts[rows].tolist(), words.ends[rows].tolist())]
        own = self.spelt.setdefault(lang, ([], []))
        own[0].append(keys[rows])
        own[1].append(texts)


def _word_stripes(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(buckets)
        for batch in batches:
            for part in chunks(batch, "text"):
                words, keys, goes_on, own, langs = _keyed(part)
                at = np.flatnonzero(goes_on)
                held.add(keys[at], keys[at + 1])
                held.total(keys)
                held.total(own)
                _, first = np.unique(keys, return_index=True)
                for key, lang in langs.items():
                    held.spell(keys, words, first[own[first] == key], lang)
                    none = Words(words.data, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(2, np.int64))
                    held.spell(np.array([key]), none, np.zeros(1, np.int64), lang)  # the empty prefix
                if held.size >= _FLUSH:
                    held.merge()
                    if held.size >= _FLUSH // 2:
                        yield from held.send()
        yield from held.send()

    return work


def _pair_stripes(buckets: int, shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = np.frombuffer(shared.value, np.uint8), _Held(buckets)
        for batch in batches:
            for part in chunks(batch, "text"):
                _, keys, goes_on, _, _ = _keyed(part)
                at = np.flatnonzero(goes_on)
                pairs = pair_key(keys[at], keys[at + 1])
                frequent = np.zeros(len(keys) + 1, bool)
                frequent[at] = _listed(bits, pairs)
                both = np.flatnonzero(frequent[:-1] & frequent[1:])
                place = np.searchsorted(at, both)
                held.add(pairs[place], keys[both + 2])
                if held.size >= _FLUSH:
                    held.merge()
                    if held.size >= _FLUSH // 2:
                        yield from held.send()
        yield from held.send()

    return work


def _slots(keys: np.ndarray, size: int) -> list[np.ndarray]:
    return [(mix(keys, 46 + k) % U(size)).astype(np.int64) for k in range(3)]


def _listed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for slot in _slots(keys, len(bits) * 8):
        out &= (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return out


def _merge_bucket(least: int):
    """Rows of a bucket that occur ``least`` times: (kind, one, two, n); words with their text and language."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        text = table.filter(pa.compute.is_valid(table.column("lang")))
        table = table.filter(pa.compute.is_null(table.column("lang")))
        columns = [column_bytes(table.column(c), k) for c, k in (("prefixes", U), ("nexts", U), ("counts", np.uint32))]
        prefixes, nexts, counts = merged(columns[0], columns[1], columns[2].astype(np.int64))
        spelt: dict[int, tuple[str, str]] = {}
        total = nexts == _TOTAL
        frequent = counts >= least
        wanted = prefixes[total & frequent]
        for own, lang, words in zip(text.column("prefixes").to_pylist(), text.column("lang").to_pylist(), text.column("words").to_pylist()):
            own, words = np.frombuffer(own, U), words.split(b" ")
            place = np.searchsorted(wanted, own)
            found = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == own) if len(wanted) else []
            for i in found:
                entry = (lang, words[i].decode("utf-8", "surrogatepass"))
                if spelt.setdefault(int(own[i]), entry) != entry:
                    raise ValueError(f"{entry} and {spelt[int(own[i])]} have one hash")
        rows = np.flatnonzero(frequent)
        named = [spelt[int(p)] if t else (None, None) for p, t in zip(prefixes[rows], total[rows])]
        return pa.table(
            {
                "one": pa.array(prefixes[rows].view(np.int64)), "two": pa.array(nexts[rows].view(np.int64)), "n": pa.array(counts[rows]),
                "pair": pa.array(pair_key(prefixes[rows], nexts[rows]).view(np.int64)),
                "lang": pa.array([x for x, _ in named], pa.string()), "word": pa.array([x for _, x in named], pa.string()),
            }
        )

    return work


def _filter(pairs: DataFrame) -> bytes:
    """A Bloom filter of ``FILTER_BITS`` bits, however many pairs there are: tasks send the bytes they set, in slices."""
    size, slice_bytes = FILTER_BITS, FILTER_BITS // 8 // 64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            keys = np.asarray(batch.column("pair")).view(U)
            for slot in _slots(keys, size):
                np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        cut = bits.reshape(64, slice_bytes)
        some = np.flatnonzero(cut.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), binary([cut[i].tobytes() for i in some])], names=["part", "bits"])

    def either(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(slice_bytes, np.uint8)
        for own in table.column("bits"):
            bits |= np.frombuffer(own.as_py(), np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": binary([bits.tobytes()])})

    parts = group_arrow(map_arrow(pairs.select("pair"), work, "part int, bits binary"), ["part"], either, "part int, bits binary")
    out = np.zeros((64, slice_bytes), np.uint8)
    for row in parts.collect():  # 64 slices of fixed size
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def _score(a: str, left: Column, right: Column) -> Column:
    big = lambda c: c.cast("decimal(19,0)")
    product = (big(F.col(a)) * big(F.col(a)) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", product, (big(left) * big(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000, percent: int = 50) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the cut with the lowest score (ties: the earliest), ``n`` the
    language's words. A phrase inside a longer candidate with at least ``percent`` of its count is left out.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    buckets = bucket_count(texts)
    kept = "one long, two long, n long, pair long, lang string, word string"
    words = saved(group_arrow(map_arrow(texts, _word_stripes(buckets), _STRIPES), ["bucket"], _merge_bucket(least), kept), "stripes")
    totals = words.filter("two = 0").select(F.col("one").alias("key"), "n", "lang", "word")
    pairs = words.filter("two <> 0").select("one", "two", "n", "pair")
    shared = spark.sparkContext.broadcast(_filter(pairs))
    merged_pairs = group_arrow(map_arrow(texts, _pair_stripes(buckets, shared), _STRIPES), ["bucket"], _merge_bucket_pairs(least), "pair long, three long, a long")
    triples = saved(merged_pairs.join(pairs.withColumnRenamed("n", "head"), "pair").select("one", "two", "three", "a", "head"), "triples")

    # the largest count of a longer phrase around each pair, from either side
    around = triples.groupBy("one", "two").agg(F.max("a").alias("most")).unionByName(triples.groupBy(F.col("two").alias("one"), F.col("three").alias("two")).agg(F.max("a").alias("most")))
    around = around.groupBy("one", "two").agg(F.max("most").alias("most"))
    twos = pairs.join(around, ["one", "two"], "left").filter(f"most IS NULL OR 100 * most < {percent} * n").select("one", "two", F.lit(None).cast("long").alias("three"), F.col("n").alias("a"), F.lit(None).cast("long").alias("head"))

    tail = pairs.select(F.col("one").alias("t1"), F.col("two").alias("t2"), F.col("n").alias("tail"))
    every = twos.withColumn("tail", F.lit(None).cast("long")).unionByName(triples.join(tail, (F.col("two") == F.col("t1")) & (F.col("three") == F.col("t2"))).drop("t1", "t2"))
    for place in ("one", "two", "three"):
        side = totals.select(F.col("key").alias("k"), F.col("n").alias(f"n_{place}"), F.col("word").alias(f"w_{place}"), *(["lang"] if place == "one" else []))
        every = every.join(side, F.col(place) == F.col("k"), "left" if place == "three" else "inner").drop("k")

    pair_score = _score("a", F.col("n_one"), F.col("n_two"))
    early, late = _score("a", F.col("n_one"), F.col("tail")), _score("a", F.col("head"), F.col("n_three"))
    cut = F.when(F.col("three").isNull(), F.struct(pair_score.alias("score"), F.col("n_one").alias("l"), F.col("n_two").alias("r")))
    cut = cut.when(early <= late, F.struct(early.alias("score"), F.col("n_one").alias("l"), F.col("tail").alias("r"))).otherwise(F.struct(late.alias("score"), F.col("head").alias("l"), F.col("n_three").alias("r")))
    scored = every.select("lang", F.concat_ws(" ", "w_one", "w_two", "w_three").alias("phrase"), "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(_SALTS))).orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = totals.filter("word = ''").select(F.col("lang").alias("_lang"), F.col("n"))  # at most top * _SALTS rows of a language meet it
    return ranked.join(n, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _merge_bucket_pairs(least: int):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        columns = [column_bytes(table.column(c), k) for c, k in (("prefixes", U), ("nexts", U), ("counts", np.uint32))]
        prefixes, nexts, counts = merged(columns[0], columns[1], columns[2].astype(np.int64))
        rows = np.flatnonzero(counts >= least)
        return pa.table({"pair": pa.array(prefixes[rows].view(np.int64)), "three": pa.array(nexts[rows].view(np.int64)), "a": pa.array(counts[rows])})

    return work
