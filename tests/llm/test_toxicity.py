import numpy as np
import pytest

pytest.importorskip("quern.llm")

from quern.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    got = toxicity.severity(docs, model).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    caught, wrong = got[got.label == 1].toxic, got[got.label == 0].toxic
    assert caught.mean() > 0.85 and wrong.mean() < 0.02
    assert list(model.thresholds) == sorted(model.thresholds)


def test_planted_words(spark):
    clean, foul = ["word%d and thing%d are here" % (i * 7, i) if i % 2 else "x%d" % i for i in range(200)], ["Oh, you VILE-thing %d" % i for i in range(80)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(clean + foul + [None, "", "Oh you vile text " + "word " * 20000])], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, None if i % 3 else i % 2, int(i >= 200)) for i in range(280)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert len(got) == 283
    assert not any(got[i].toxic for i in range(200)) and all(got[i].toxic for i in range(200, 280))
    assert not got[280].toxic and not got[281].toxic and got[282].toxic
    assert all(abs(r.severity) <= 2 and r.grade in (0, 1, 2) for r in got.values())
    assert [got[i].toxic for i in (0, 200)] == [got[i].severity >= toxicity.THRESHOLD for i in (0, 200)]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(200)) | {280, 281}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.severity(docs, model).count() == 1 and toxicity.severity(docs.limit(0), model).count() == 0


def test_slopes():
    """The fit's likelihood at its end is at least that of its neighbours."""
    rng = np.random.default_rng(0)
    n = 600
    x = rng.random(n) < 0.3
    grades = np.where(x, rng.integers(0, 3, n), (rng.random(n) < 0.05).astype(int))
    model = toxicity.fit(grades, np.flatnonzero(x), np.full(x.sum(), 7), decay=0.0)
    (_, w), (a, b) = model.weights[0], model.thresholds

    def likelihood(w, a, b):
        z = w * x
        p1, p2 = 1 / (1 + np.exp(a - z)), 1 / (1 + np.exp(b - z))
        return np.log(np.select([grades == 0, grades == 1], [1 - p1, p1 - p2], p2)).mean()

    best = likelihood(w, a, b)
    for d in (-0.1, 0.1):
        assert best >= max(likelihood(w + d, a, b), likelihood(w, a + d, b), likelihood(w, a, b + d)) - 1e-5
