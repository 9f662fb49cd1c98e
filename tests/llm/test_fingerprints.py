import hashlib
import itertools
import random
import re

import pytest

pytest.importorskip("quern.llm")

from pyspark.sql import functions as F

from quern.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, id string, row int, fingerprint string"
ODD = [None, "", "\n\n", "a", "abc\n" * 400, "é" * 1000, "\U0001f600ab" * 3, "x " * 30_000, "same", "same"]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "i", 1, "f") for i, t in rows], SCHEMA).repartition(parts)


def paragraphs(text):
    return set(re.findall(rf"[^\n]{{1,{fp.PARAGRAPH}}}", text))


def like(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for (i, t), (_, u) in zip(rows, [*rows[1:], *rows[:1]], strict=True):
        q = len(t) // 4
        e = t[: len(t) - q] + u[:q]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), like(t, e), like(t, u)))
    return sorted(out, key=str)


def check(got, rows):
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == brute(rows)


def test_likeness_equals_brute_force(spark):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = [(7 * i - 300, t) for i, t in enumerate(ODD + real)] + [(10**15, "far away\nline"), (None, "null id"), (None, "b")]
    random.Random(2).shuffle(rows)
    got = fp.fingerprints(frame(spark, rows)).collect()
    check(got, rows)
    text = dict((i, t) for i, t in rows if i is not None)
    by_text = {}
    for r in got:
        if r.doc_id is not None:
            assert by_text.setdefault(text[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert len({v for k, v in by_text.items() if paragraphs(k)}) == len({frozenset(paragraphs(k)) for k in by_text if paragraphs(k)})


def test_single_row_and_ties(spark):
    for rows in ([(1, "only one row here")], [(1, "b"), (1, "a"), (1, "a"), (2, "c" * 500)], [(None, None)]):
        check(fp.fingerprints(frame(spark, rows)).collect(), rows)
    assert fp.fingerprints(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_retries_grow(spark, monkeypatch):
    """With tables too small for the differences the first retry fails and the next ones recover all."""
    monkeypatch.setattr(fp, "GROWTH", 2)
    rng = random.Random(5)
    rows = [(i, "\n".join(str(rng.random()) for _ in range(40))) for i in range(12)]
    check(fp.fingerprints(frame(spark, rows)).collect(), rows)


def test_peeling_counts_both_sides(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [3, 4, 5, 6]), ([], [9]), ([], [])], "a array<long>, b array<long>")
    got = df.select(fp.peeled(fp.minus(fp.sketch(F.col("a")), fp.sketch(F.col("b")))).alias("p")).select("p.more", "p.less", fp.empty(F.col("p.cells")).alias("done")).collect()
    assert [tuple(r) for r in got] == [(2, 1, True), (0, 1, True), (0, 0, True)]


def test_ids_of_other_types(spark):
    rows = [(i, f"line {i}\nshared\n" * (i % 5)) for i in range(300)]
    want = {f"doc-{i:06d}": r for i, *r in ((r.doc_id, r.edited_sha256, r.near_edited, r.near_next) for r in fp.fingerprints(frame(spark, rows)).collect())}
    named = frame(spark, rows).withColumn("doc_id", F.format_string("doc-%06d", "doc_id"))
    assert {r.doc_id: [r.edited_sha256, r.near_edited, r.near_next] for r in fp.fingerprints(named).collect()} == want
    dates = frame(spark, rows).withColumn("doc_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")))
    assert sorted(r.edited_sha256 for r in fp.fingerprints(dates).collect()) == sorted(x[0] for x in want.values())


def test_what_retries_leave_is_compared(spark, monkeypatch):
    rows = [(i, "\n".join(f"{i} {k}" for k in range(60))) for i in range(12)]
    want = {r.doc_id: (r.near_edited, r.near_next) for r in fp.fingerprints(frame(spark, rows)).collect()}
    monkeypatch.setattr(fp, "GROWTH", 1)
    monkeypatch.setattr(fp, "RETRIES", 1)
    assert {r.doc_id: (r.near_edited, r.near_next) for r in fp.fingerprints(frame(spark, rows)).collect()} == want


def test_buckets_of_clustered_ids(spark):
    ids = [*range(3000), *range(10**9, 10**9 + 3000), *(10**17 + 10**6 * i for i in range(3000)), None, None]
    docs = spark.createDataFrame([(i,) for i in ids], "id long")
    got = docs.select("id", fp.buckets(docs, 300).alias("bucket")).collect()
    known = sorted((r.id, r.bucket) for r in got if r.id is not None)
    assert [b for _, b in known] == sorted(b for _, b in known) and {r.bucket for r in got if r.id is None} == {-1}
    sizes = [sum(1 for _ in g) for _, g in itertools.groupby(b for _, b in known)]
    assert len(sizes) >= 290 and max(sizes) <= 60
