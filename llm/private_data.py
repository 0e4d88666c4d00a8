"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Kinds are email, ip, card and phone; places are code points, the end exclusive. What the fixed patterns and their checks find (base
spans) always counts. Candidates beyond them are obfuscated addresses (``name [at] site [dot] org``), addresses with bracketed dots or of
eight hexadecimal groups, numbers that pass the card checksum in other groupings, and grouped numbers without a country code.

1. Six labelers vote for, against or not at all on every candidate: the patterns, the writing, gazetteers (top-level domains, issuers,
   country codes, reserved networks), words before it that speak for or against, and what it touches.
2. Votes are counted over all documents: at most 4 * 3**6 rows. Expectation-maximisation on these counts estimates, per kind, how often
   each labeler casts each vote on personal and on other spans, and from that the probability of every combination of votes.
3. Logistic regression on hashed features of span and context learns these probabilities from at most ``SAMPLE`` distinct
   candidates (those with the smallest hashes). It decides on the candidates that are not base spans.

Nulls: a null text is empty; a null id comes out as it is. Repeated rows all come out. An empty table gives an empty result. Time is linear
in the text. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import map_arrow, saved
from llm.kernel import chunks

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SAMPLE, BITS, ROUNDS, STEPS = 8192, 12, 60, 300
LABELERS = 6
_SPANS = "array<struct<kind:string,start:long,end:long,text:string,score:double,base:boolean>>"

# The base patterns. Emails are found from their @, whose local part is the run of its characters before it.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DOT = r"(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)"
_HIDDEN = re.compile(rf"(?: ?[(\[{{] ?at ?[)\]}}] ?| at (?=[a-z0-9-]{{1,63}} dot ))[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{2,63}}){{1,4}}", re.I)
_NUMBER = re.compile(r"[0-9(\[][0-9 ().\[\]/-]*[0-9]")
_GROUPS = re.compile(r"[0-9]+")
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_GROUPED = re.compile(r"(?:\([0-9]{2,5}\) ?|0[0-9]{1,5}[ ./-]|[0-9]{3}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,5}){1,4}|(?:\([0-9]{2,5}\) ?|0[0-9]{2,5}[ /-])[0-9]{5,9}")
_WORD = re.compile(r"[^\W\d_]+")

TLDS = frozenset("com org net edu gov int info biz io de fr es it nl uk us eu ch at be pl pt ru cn jp in br au ca se no dk fi cz gr ie mx".split())
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
FOR = {
    EMAIL: frozenset("mail email emails contact write courriel correo kontakt address adresse".split()),
    IP: frozenset("ip ips host server client address adresse login from dns gateway".split()),
    CARD: frozenset("card cards visa mastercard amex credit debit carte karte kreditkarte tarjeta payment".split()),
    PHONE: frozenset("phone tel telephone call mobile cell fax fon telefon handy mobil téléphone teléfono tlf portable whatsapp".split()),
}
AGAINST = frozenset("version v ver isbn issn order invoice id ref no nr number token hash sha serial sku build ticket rechnung facture pedido section page year".split())


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    features: list[int]


def luhn(digits: str) -> bool:
    """The card checksum: from the right, every second digit doubled."""
    back = digits[::-1]
    odd = sum(map(int, back[::2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in back[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_GROUPS.findall(text))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, passes) of everything the base patterns match, failing matches too."""
    if "@" in text:
        floor = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                yield EMAIL, start, m.end(), True
                floor = m.end()
    for m in _IP.finditer(text):
        yield IP, m.start(), m.end(), all(map(_byte, m.group().split(".")))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m.group())
            if 14 <= len(digits):
                yield CARD, m.start(), m.end(), len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield PHONE, m.start(), m.end(), 10 <= len(_digits(m.group())) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    return sorted((s, k, e) for k, s, e, passes in matches(text) if passes)


def _beyond(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of candidates outside the taken places."""
    free = lambda s, e: all(e <= a or b <= s for a, b in _near(taken, s, e))
    low = text.lower()
    if "at]" in low or "at)" in low or "at}" in low or "at ]" in low or "at )" in low or "at }" in low or " dot " in low:
        floor = 0
        for m in _HIDDEN.finditer(text):
            start = m.start()
            while start > max(floor, m.start() - 64) and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start() and free(start, m.end()):
                yield EMAIL, start, m.end()
                floor = m.end()
    if low.count(":") >= 7:
        for m in _SIX.finditer(text):
            if free(m.start(), m.end()):
                yield IP, m.start(), m.end()
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 9 or m.end() - m.start() > 48 or not free(m.start(), m.end()):
            continue
        own = m.group()
        groups = _GROUPS.findall(own)
        digits = "".join(groups)
        if len(groups) == 4 and re.fullmatch(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}", own) and all(map(_byte, groups)):
            yield IP, m.start(), m.end()
        elif 13 <= len(digits) <= 19 and len(groups) > 1 and min(map(len, groups)) >= 3 and luhn(digits):
            yield CARD, m.start(), m.end()
        elif 9 <= len(digits) <= 15 and _GROUPED.fullmatch(own):
            yield PHONE, m.start(), m.end()


def _near(taken: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Places that may overlap; ``taken`` is sorted, and spans of one kind do not overlap."""
    from bisect import bisect_left

    at = bisect_left(taken, (end, 0))
    return taken[max(0, at - 8) : at]


def _shape(c: str) -> str:
    return "0" if not c else "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c if c in ".,;:()[]\"'=/-@+" else "?"


def _judged(text: str, kind: int, start: int, end: int, base: bool, failed: bool) -> Candidate:
    own, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 24]
    digits, groups = _digits(own), [len(g) for g in _GROUPS.findall(own)]
    words = [w.lower() for w in _WORD.findall(before)][-4:]
    nexts = [w.lower() for w in _WORD.findall(after)][:1]
    left, right = _shape(before[-1:]), _shape(after[:1])
    label = own.rsplit(".", 1)[-1].lower()
    if kind == EMAIL:
        writing, known = (1 if "@" in own and label.isalpha() and 2 <= len(label) <= 6 else -1 if "@" in own else 0), (1 if label.strip(" )]}") in TLDS else 0)
    elif kind == IP:
        first = 1 if ":" in own else int(_GROUPS.search(own).group().lstrip("0")[:4] or 0)
        plain = re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", own) is not None
        writing, known = (1 if plain and not re.search(r"(?:^|\.)0[0-9]", own) else -1 if "." in own and "[" not in own and "(" not in own else 0), (-1 if first in (0, 127, 255) or first > 223 else 1)
    elif kind == CARD:
        writing = 1 if groups in ([16], [15], [4, 4, 4, 4], [4, 6, 5]) else -1
        known = 1 if digits[:1] == "4" or digits[:2] in ("34", "37", "51", "52", "53", "54", "55", "62", "65") or digits[:4] == "6011" or 2221 <= int(digits[:4] or 0) <= 2720 else -1
    else:
        code = own.startswith("+") and any(digits[:n] in CODES for n in (1, 2))
        writing, known = (1 if len(groups) > 1 and own.count("(") == own.count(")") else -1 if own.count("(") != own.count(")") else 0), (1 if code else -1 if own.startswith("+") else 0)
    votes = (
        -1 if failed else int(base), writing, known, int(any(w in FOR[kind] for w in words)), -int(any(w in AGAINST for w in words[-2:])), -1 if left in "9a=@" and left != "0" or right in "9a@" and right != "0" else 1,
    )
    named = ["b", f"n{len(digits)}", f"g{len(groups)}", f"l{left}", f"r{right}", f"w{words[-1] if words else ''}", f"x{nexts[0] if nexts else ''}", *(f"v{k}{v}" for k, v in enumerate(votes))]
    return Candidate(kind, start, end, base, votes, sorted(zlib.crc32(f"{kind}{f}".encode("utf-8", "surrogatepass")) & (1 << BITS) - 1 for f in named))


def candidates(text: str) -> list[Candidate]:
    """All candidates of a text: base spans, failing matches of the base patterns, and what else looks alike."""
    found = list(matches(text))
    taken = sorted((s, e) for k, s, e, passes in found if passes or k == CARD)
    out = [_judged(text, k, s, e, passes, not passes) for k, s, e, passes in found]
    return out + [_judged(text, k, s, e, False, False) for k, s, e in _beyond(text, taken)]


def _vote_code(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def expectation(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Probability that a span with these votes (-1, 0, 1 per labeler) is personal data, per row.

    Each kind has its own share and, for both classes, the chances of each labeler's three votes. The prior leans towards
    labelers that are right more often than not, which also says which class is which.
    """
    out = np.zeros(len(kinds))
    for kind in np.unique(kinds):
        rows = kinds == kind
        v, n = votes[rows] + 1, counts[rows].astype(float)
        prior = np.array([[4.0, 4.0, 1.0], [1.0, 4.0, 4.0]])[:, None, :].repeat(v.shape[1], 1)  # class, labeler, vote
        chance, share = prior / prior.sum(2, keepdims=True), 0.5
        for _ in range(rounds):
            log = np.log([1 - share, share])[:, None] + np.log(chance[:, np.arange(v.shape[1]), v]).sum(2)
            p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            weight = np.stack([n * (1 - p), n * p])
            share = float(np.clip((weight[1].sum() + 1) / (n.sum() + 2), 1e-3, 1 - 1e-3))
            for c in (0, 1):
                for k in range(v.shape[1]):
                    own = prior[c, k] + np.bincount(v[:, k], weight[c], 3)
                    chance[c, k] = own / own.sum()
        out[rows] = p
    return out


def regression(features: list[list[int]], target: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of a logistic regression on sets of hashed features, towards soft targets."""
    w = np.zeros(1 << BITS)
    if not len(features):
        return w
    flat = np.concatenate([np.array(f) for f in features])
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
    scale, seen = weight / weight.sum(), np.full(1 << BITS, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(owner, w[flat], len(features))))
        g = np.bincount(flat, ((p - target) * scale)[owner], 1 << BITS) + 1e-5 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            rows = [c for text in part.column("text").to_pylist() for c in candidates(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.kind for c in rows], pa.int32()), pa.array([_vote_code(c.votes) for c in rows], pa.int32()), pa.array([c.features for c in rows], pa.list_(pa.int32()))], names=["kind", "votes", "features"]
            )


def _texts(docs: DataFrame, text_col: str, *others) -> DataFrame:
    return docs.select(*others, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, from the candidates of all documents."""
    found = map_arrow(_texts(docs, text_col), _found, "kind int, votes int, features array<int>")
    distinct = saved(found.groupBy("kind", "votes", "features").count(), "candidates")
    counts = distinct.groupBy("kind", "votes").agg(F.sum("count").alias("n")).orderBy("kind", "votes").collect()  # at most 4 * 3**6 rows
    if not counts:
        return np.zeros(1 << BITS)
    votes = np.array([[r.votes // 3 ** (LABELERS - 1 - k) % 3 - 1 for k in range(LABELERS)] for r in counts])
    likely = dict(zip([(r.kind, r.votes) for r in counts], expectation(np.array([r.kind for r in counts]), votes, np.array([r.n for r in counts]))))
    chosen = distinct.orderBy(F.xxhash64("kind", "votes", "features"), "kind", "votes", "features").limit(sample).collect()
    return regression([r.features for r in chosen], np.array([likely[r.kind, r.votes] for r in chosen]), 1 + np.log(np.array([r["count"] for r in chosen])))


def find(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Per row: id and ``spans`` in order of start and kind: base spans, and candidates with a score of at least ``least`` outside them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64()), ("base", pa.bool_())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    own = []
                    for c in candidates(text):
                        score = float(1 / (1 + np.exp(-weights[c.features].sum())))
                        if c.base or (score >= least and c.votes[0] >= 0):  # a failed check is final
                            own.append((c.start, c.kind, c.end, score, c.base))
                    own.sort()
                    rows.append([{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e], "score": p, "base": b} for s, k, e, p, b in own])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, kind)], names=["id", "spans"])

    rows = _texts(docs, text_col, F.col(f"`{id_col}`").cast("long").alias("id"))
    return map_arrow(rows, work, f"id long, spans {_SPANS}").withColumnRenamed("id", id_col)
