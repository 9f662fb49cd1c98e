import pytest

pytest.importorskip("quern.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quern.llm import toxicity as tox
from quern.llm.common import table

DATA = "/root/testdata/sf0.01"


def grams(text, n):
    w = [x for x in text.encode().lower().split()]
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_stages_equal_brute_force(spark):
    docs = table(spark, DATA, "documents")
    model = tox.train(docs, table(spark, DATA, "labels"))
    bad = {r.doc_id for r in tox.severity(docs, model).collect() if r.toxic}
    left = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in bad}
    keep = {}
    for i, t in left.items():
        k = t.encode().lower()
        keep[k] = max(keep.get(k, i), i)
    left = {i: left[i] for i in keep.values()}
    sets = {i: grams(t, 5) for i, t in left.items()}
    up = {i: i for i in left}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in left:
        for j in left:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    want = {i for i in left if top(i) == i}
    assert bad and len(want) < len(left) < docs.count() - len(bad)
    got = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in got.collect()} == want
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, DATA)
        assert step.columns == docs.columns


def test_stages_take_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", None, None, 0), (3, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, DATA).count() <= 3
