"""Personal data, prefix tries and collocations against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import difference
from llm import checks, collocations, prefix_trie, private_data

SF = "/root/testdata/sf0.001"


# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(d - 9 if d > 9 else d for d in doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(3)
    parts = ["a", "Z9", "@", "@x.y", ".", "..", "-", "+", "+1", "%", "1", "23", "255", "256", "007", " ", "(", ")", "4111111111111111", "4929 3483 8514 6306", "1.2.3.4", "+49 30 1234567", "é", "_", "\n", "a@b.c@d.e", "²"]
    found = 0
    for _ in range(20000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12)))
        got = private_data.base_spans(text)
        assert got == plain_spans(text), text
        found += len(got)
    assert found > 5000


def test_spans_take_linear_time():
    start = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1(" * 130_000, "1 " * 200_000, "a@" * 200_000, "(at) " * 80_000, "1:" * 200_000, "[at]a.bb" * 50_000):
        private_data.candidates(text)
    assert time.time() - start < 60


@pytest.fixture(scope="module")
def people(spark):
    rnd = random.Random(8)
    words = "the of and to in is it on as at by we".split()
    rows = []
    for i in range(300):
        w = [rnd.choice(words) for _ in range(20)]
        kind = i % 6
        if kind == 0:
            w[10:10] = ["mail", f"ann{i}@site{i % 7}.org"]
        elif kind == 1:
            w[10:10] = ["phone", f"+1 (2{i:02d}) 555-01{i % 100:02d}"[:17]]
        elif kind == 2:
            w[10:10] = ["server", f"10.{i % 250}.3.4"]
        elif kind == 3:
            w[10:10] = ["order", f"4111 1111 1111 {1112 + i % 7:04d}"]
        elif kind == 4:
            w[10:10] = ["card", "4111 1111 1111 1111"]
        rows.append((i, " ".join(w)))
    rows += [(900, "call (487) 555-7209 now"), (901, "mail bob [at] site [dot] org please"), (902, "card 4111.1111.1111.1111 valid"), (903, None), (904, ""), (None, "x@y.zz"), (905, "at 10:20:30 in 2024-01-15, 978-3-16-148410-0")]
    return spark.createDataFrame([(i, t, "?", "?", "?") for i, t in rows + rows[:2]], "doc_id long, text string, id string, spans string, kind string")


def test_spans_beyond_the_base(spark, people):
    model = private_data.train(people)
    got = private_data.find(people, model).collect()
    assert len(got) == people.count()
    texts = {r.doc_id: r.text or "" for r in people.collect()}
    for r in got:
        base = [(s.start, private_data.KINDS.index(s.kind), s.end) for s in r.spans if s.base]
        assert base == plain_spans(texts[r.doc_id])
        assert all(s.text == texts[r.doc_id][s.start : s.end] for s in r.spans)
    more = {(r.doc_id, s.kind, s.text) for r in got for s in r.spans if not s.base}
    assert more == {(900, "phone", "(487) 555-7209"), (901, "email", "bob [at] site [dot] org"), (902, "card", "4111.1111.1111.1111")}
    assert (private_data.train(people) == model).all()


def test_expectation_finds_the_reliable_labelers():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.6, 0.55])
    votes = np.where(rng.random((4000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random((4000, 4)) < 0.1] = 0
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = private_data.expectation(np.zeros(len(patterns), int), patterns, counts)[back.ravel()]
    known = np.log(0.3 / 0.7) + (votes * np.log(right / (1 - right))).sum(1) > 0  # nothing decides better than the true reliabilities
    best, majority = (known == truth).mean(), ((votes.sum(1) > 0) == truth).mean()
    assert ((p > 0.5) == truth).mean() > best - 0.01 > majority


def test_private_data_on_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert private_data.find(none, private_data.train(none)).count() == 0


def test_private_data_query_equals_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = checks.QUERIES["op11_private_data"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{private_data.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        n = Counter(private_data.KINDS[k] for _, k, _ in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [n[k] for k in private_data.KINDS]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


# prefix tries


def plain_trie(rows, share):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    for c in own:
        own[c] = [x[2:] for x in sorted(own[c])]
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4 if share else 0
        lender = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = own.get(lender, [])[:h] + own[c][h:] if share else own[c]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("share,slab,burst", [(True, 1024, 1 << 18), (True, 3, 5), (False, 4, 1), (False, 1024, 20)])
def test_prefix_trie_equals_brute_force(spark, share, slab, burst):
    rnd = random.Random(5)
    rows = []
    for c in [*range(-25, 90), 10**12]:
        start = rnd.randrange(4)
        for t in range(rnd.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rnd.choice(["user", "bot", None]) if t > 1 else "user", f"t{start} a b" if t == 0 else rnd.choice(["x", "y z", "", None])))
    rows += [(500 + k, t, "user", f"long {t}") for k in range(3) for t in range(17 + k)]  # copies of a long one
    rows += [(600 + k, t, "user", "hot hot") for k in range(60) for t in range(3)]  # a third are copies
    rows += [(7, None, "system", "first"), (None, 1, "user", "lost"), rows[0], rows[0], (700, 1, "u\x00", "v"), (701, 1, "u", "\x00v")]
    rnd.shuffle(rows)
    table = spark.createDataFrame([(*r, "?", "?", "?") for r in rows], "conv_id long, turn long, role string, text string, n string, node string, path string")
    got = prefix_trie.prefix_trie(table, share=share, slab=slab, burst=burst).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows, share)


def test_prefix_trie_on_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema), share=True).count() == 0
    one = prefix_trie.prefix_trie(spark.createDataFrame([(21, 1, "user", "z" * 100_000)], schema), share=True).collect()
    assert sorted((tuple(r) for r in one), key=str) == plain_trie([(21, 1, "user", "z" * 100_000)], True)


# collocations


def plain_collocations(rows, least, top, percent=50):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        longer = [(p, n) for p, n in f.items() if len(p) == 3 and n >= least]
        ranked = []
        for p, a in f.items():
            if len(p) < 2 or a < least or (len(p) == 2 and any(p in (q[:2], q[1:]) and 100 * n >= percent * a for q, n in longer)):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least,top", [(2, 40), (3, 2000)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, top):
    monkeypatch.setattr(collocations, "_FLUSH", 500)
    rnd = random.Random(6)
    words = ["a", "B", "cé", "New", "York", "new", "york", "d.", "e,", "\x0b", "tab\tword", "漢", "Straße!", "z" * 70, "z" * 70 + "y"]
    rows = [(rnd.choice(["en", "de", None, "und", ""]), " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for _ in range(200)]
    rows += [("en", "hot phrase here " * 300)] * 3 + [(None, None), ("en", ""), ("fr", "only one"), ("en", "A" * 100_000)]
    docs = spark.createDataFrame([(x, t, "?", "?") for x, t in rows], "lang string, text string, rank string, word string")
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect())
    assert got == plain_collocations(rows, least, top)


def test_collocations_on_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_filter_lets_every_pair_through(spark, monkeypatch):
    """A full filter only costs time."""
    monkeypatch.setattr(collocations, "FILTER_BITS", 512)
    rows = [("en", f"w{i % 40} w{i % 7} w{i % 5}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=4).collect()) == plain_collocations(rows, 4, 2000)


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_collocations"])
def test_later_queries_equal_their_sql(spark, name):
    assert difference(spark, name, checks.QUERIES[name], checks.ORACLE[name], SF) is None
