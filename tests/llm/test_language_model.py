import math
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quern.llm")

from quern.llm import language_model as lm
from quern.llm import packed

SCHEMA = "doc_id long, text string, id string, part int"
ODD = [None, "", " \t", "The the THE", "É é \x1c \x85 a", "x" * 3000, "a b " * 4000]


def split(text):
    out, word = [], ""
    for c in text or "":
        if c == " " or "\x09" <= c <= "\x0d":
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return [*out, *([word] if word else []), None]


class Model:
    """The model as its formulas say, by dictionaries over all texts."""

    def __init__(self, rows):
        self.held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
        self.c, self.b, triples = Counter(), Counter(), Counter()
        for i, t in rows:
            if not self.held[i]:
                w = split(t)
                before = [None, *w[:-1]]
                self.c.update(w)
                self.b.update(zip(before, w, strict=True))
                triples.update(zip(before, w, w[1:], strict=False))
        self.t = {k: n for k, n in triples.items() if self.b[k[:2]] >= lm.LEAST and self.b[k[1:]] >= lm.LEAST}
        self.types = {x for _, t in rows for x in split(t)}
        self.fans = Counter(v for v, _ in self.b)
        self.n = sum(self.c.values())
        self.d1, self.d2 = (self.discount(Counter(x.values())) for x in (self.c, self.b))

    @staticmethod
    def discount(sizes):
        return min(lm.MOST, sizes[1] / (sizes[1] + 2 * sizes[2])) if sizes[1] else lm.DISCOUNT

    def p1(self, w):
        return (max(self.c[w] - self.d1, 0) + self.d1 * len(self.c) / len(self.types)) / self.n if self.n else 1 / len(self.types)

    def p2(self, v, w):
        if not self.c[v]:
            return self.p1(w)
        return (self.b[v, w] - self.d2 if self.b[v, w] else 0) / self.c[v] + self.d2 * self.fans[v] / self.c[v] * self.p1(w)

    def p3(self, u, v, w):
        if self.b[u, v] < lm.LEAST:
            return self.p2(v, w)
        return (1 - lm.FAILURE) * self.t.get((u, v, w), 0) / self.b[u, v] + lm.FAILURE * self.p2(v, w)


def brute(rows):
    m = Model(rows)
    n, v = m.n, len(m.c)
    out = []
    for i, t in rows:
        w = split(t)
        base = sum(math.log10((m.c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        before = [None, *w[:-1]]
        s = sum(math.log10(m.p3(before[k - 1], before[k], w[k]) if k else m.p2(None, w[0])) for k in range(len(w)))
        out.append((i, m.held[i], len(w), sum(m.c[x] > 0 for x in w), n, base, s))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5] and a.base_score == pytest.approx(b[5], abs=1e-6) and a.score == pytest.approx(b[6], abs=1e-6)


def test_scores_equal_brute_force(spark, monkeypatch):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = list(enumerate([*ODD, *real, *ODD])) + [(None, "a b c"), (3, "a twin"), (3, "a twin"), (7, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    want = brute(rows)
    same(lm.score(df).collect(), want)
    monkeypatch.setattr(lm, "PART", 20_000)
    same(lm.score(df).collect(), want)
    held = [r for r in want if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def documents(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def test_states_sum_to_one(spark):
    """Over all words, those that training lacks too, the weights of the root and of a word's state sum to 1, those of a pair's to 1 at most."""
    m = Model(documents(spark))
    assert any(not m.c[w] for w in m.types)
    assert sum(map(m.p1, m.types)) == pytest.approx(1)
    for v in [None, *list(m.c)[:40:4]]:
        assert sum(m.p2(v, w) for w in m.types) == pytest.approx(1)
    often = [k for k, n in m.b.items() if n >= lm.LEAST]
    for u, v in often[:: len(often) // 10]:
        assert 0.1 < sum(m.p3(u, v, w) for w in m.types) <= 1 + 1e-9
    assert max(m.p1(w) for w in m.types if not m.c[w]) <= min(m.p1(w) for w in m.types if m.c[w])


def test_unseen_words_score_below_prose(spark):
    rows = documents(spark)
    held = [i for i in range(10**6, 10**6 + 200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    prose = next(t for i, t in rows if t and 50 < len(t.split()) < 200)
    rows += [(held[0], prose), (held[1], " ".join("zq%dx" % k for k in range(len(prose.split()))))]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]].n_tokens == got[held[1]].n_tokens and got[held[0]].score > got[held[1]].score


def test_lanes_carry_their_state(spark, monkeypatch):
    rows = documents(spark)[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {r.doc_id: r.score for r in lm.score(df).collect()}
    part = lm.Part([i for i, _ in rows], [(t or "").encode() for _, t in rows])
    sums = {k: [int((c > 0).sum()), int(c.sum()), len(c), int((c == 1).sum()), int((c == 2).sum())] for k, c in ((k, part.counts(k)) for k in (lm.WORDS, lm.PAIRS))}
    words, pairs = part.counts(lm.WORDS), part.counts(lm.PAIRS)
    with np.errstate(divide="ignore"):
        part.find_triples(pairs)
    model = lm.Automaton(part, words, pairs, part.counts(lm.TRIPLES), np.rint(part.fans(np.maximum(pairs, 1))).astype(int), lm.Smoothing(sums))
    for lane in (1, 2, 3, 100):
        monkeypatch.setattr(lm, "LANE", lane)
        assert dict(zip(part.ids, model.scores(), strict=True)) == pytest.approx(want)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    assert lm.score(df.limit(0)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm.score(spark.createDataFrame([(only, "a b", "x", 1)], SCHEMA)).collect()
    same(got, brute([(only, "a b")]))


def test_packing_of_keys_and_counts():
    rng = np.random.default_rng(1)
    for n, high in ((0, 1), (1, 2**64 - 1), (5, 2**64 - 1), (5000, 2**64 - 1), (5000, 2**40)):
        keys = np.unique(rng.integers(0, high, n, dtype=np.uint64))
        assert (packed.unpacked_keys(packed.packed_keys(keys)) == keys).all()
        counts = rng.integers(0, 600, len(keys))
        assert (packed.unpacked_counts(packed.packed_counts(counts), len(keys)) == counts).all()
        owners = rng.integers(-(2**62), 2**62, 7)[rng.integers(0, 7, len(keys))]
        assert (packed.unpacked_owners(packed.packed_owners(owners)) == owners).all()


def test_followers_are_asked_of_repeated_words_only(spark, monkeypatch):
    tables = {}
    write = lm.written
    monkeypatch.setattr(lm, "written", lambda df, what: tables.setdefault(what, write(df, what)))
    rows = [(i, f"w{i} w{i} once{i} the thing") for i in range(40)]
    got = lm.score(spark.createDataFrame([(i, t, "i", 1) for i, t in rows], SCHEMA).repartition(1))
    same(got.collect(), brute(rows))
    asked = tables["more"].filter(f"kind = {lm.FANS} AND part >= 0").agg({"n": "sum"}).first()[0]
    assert asked == len([w for w, n in Model(rows).c.items() if n >= lm.LEAST_FANS])
