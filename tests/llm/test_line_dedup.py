import random

import pytest

pytest.importorskip("quern.llm")

from quern.llm import line_dedup

SCHEMA = "doc_id long, text string, id string, line int, class string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "i", 1, "c") for i, t in rows], SCHEMA).repartition(3)


def tokens(line):
    return {w for w in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if w}


def brute(rows, percent=80):
    seen, out = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            own = tokens(line)
            if own:
                equal = own in seen
                if equal or any(100 * len(own & x) >= percent * len(own | x) for x in seen):
                    out.append((i, k, equal))
                seen.append(own)
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the"] * 30 + ["of"] * 20 + ["w%d" % i for i in range(150)] + ["É", "é", "Ab"]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 9, 15, 40, 90]))) for _ in range(60)]
    rows = []
    for i in range(90):
        own = []
        for _ in range(rng.randrange(0, 7)):
            w = rng.choice(lines).split(" ")
            for _ in range(rng.randrange(0, 1 + len(w) // 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            own.append(rng.choice([" ", "  ", "\t"]).join(w).upper() if rng.random() < 0.1 else " ".join(w))
        rows.append((i * 3, "\n".join(own)))
    return rows + [(1, None), (4, ""), (7, "\n\n \n"), (10, "same line here\nsame line here\nsame line here now"), (None, "null id line of its own")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert any(not e for _, _, e in want) and any(e for _, _, e in want)
    df = frame(spark, rows)
    assert sorted((tuple(r) for r in line_dedup.removed_lines(df).collect()), key=str) == want


def test_texts_without_lines(spark):
    rows = [(1, "a b c d e\nx"), (2, "A b c d e\nkeep this"), (3, None), (4, "x"), (5, "a b c d f\n\na b c d e f")]
    got = line_dedup.without_lines(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "id", "line", "class"]
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a b c d e\nx", 2: "keep this", 3: None, 4: "", 5: "a b c d f\n"}
    assert line_dedup.removed_lines(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2, 6])
def test_hot_tokens_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rows = corpus(3)
    assert sorted((tuple(r) for r in line_dedup.removed_lines(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_rarities_are_those_of_all_words(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BINS", 12)
    from pyspark.sql import functions as F

    rows = [(i, " ".join(["often"] * 40 + ["twice\n"] * (i < 2) + ["w%d" % i])) for i in range(30)]
    counted = line_dedup.rarities(frame(spark, rows))
    bins = {w: b for w, b in spark.createDataFrame([(w,) for w in ("often", "twice", *("w%d" % i for i in range(30)))], "w string").select("w", line_dedup.bin_of(F.xxhash64("w"))).collect()}
    assert len(counted) == 1 << 12 and counted[bins["often"]] >= line_dedup.code(1200) and counted[bins["twice"]] >= line_dedup.code(2)
    assert sum(counted[bins["w%d" % i]] == 0 for i in range(30)) > 20


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b c d e", 0, 1, 2), (2, "a b c d e\nf", 3, 4, 5)], "doc_id long, text string, _id int, id int, gone int")
    got = line_dedup.without_lines(rows)
    assert got.columns == rows.columns and {tuple(r) for r in got.collect()} == {(1, "a b c d e", 0, 1, 2), (2, "f", 3, 4, 5)}


def test_the_table_of_bits_isnt_text_in_the_plan(spark):
    from pyspark.sql import functions as F

    keys = spark.range(0, 5000, 7).withColumn("h", F.xxhash64("id"))
    own = spark.range(5000).withColumn("own", F.xxhash64("id"))
    some = own.filter(line_dedup.may_have(keys, F.col("h"), F.col("own")))
    assert {7 * i for i in range(715)} <= {r["id"] for r in some.collect()}
    assert some.count() < 800
    nothing = own.filter(line_dedup.may_have(keys.limit(0), F.col("h"), F.col("own")))
    assert nothing.count() == 0
    assert len(some._jdf.queryExecution().toString()) < 20_000


def pairs_compared(spark, monkeypatch, rows):
    """How many pairs are verified, and the longest plan of a table that is written."""
    seen = {"pairs": 0, "plan": 0}

    def spied(df, what, real=line_dedup.written):
        seen["plan"] = max(seen["plan"], len(df._jdf.queryExecution().toString()))
        out = real(df, what)
        seen["pairs"] += out.count() if what == "pairs" else 0
        return out

    monkeypatch.setattr(line_dedup, "written", spied)
    got = sorted((tuple(r) for r in line_dedup.removed_lines(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    return seen


def test_pairs_of_a_family_grow_with_its_size(spark, monkeypatch):
    rng = random.Random(4)
    base = ["b%d" % i for i in range(60)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(60)] = "own%d" % rng.randrange(10**6)
        rows.append((i, " ".join(words)))
    seen = pairs_compared(spark, monkeypatch, rows)
    assert seen["pairs"] < 8 * len(rows)  # of 3,160
    assert seen["plan"] < 200_000  # neither holds a plan the table of rarities


def test_long_lines_that_share_words_are_seldom_compared(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(700)]
    rows = [(i, " ".join(rng.sample(vocabulary, 130))) for i in range(60)]
    rows.append((60, " ".join(rows[7][1].split(" ")[:-6])))
    assert 0 < pairs_compared(spark, monkeypatch, rows)["pairs"] < 10


def test_sets_are_made_once_and_deleted(spark, monkeypatch):
    from pathlib import Path

    files = []

    def spied(df, what, real=line_dedup.written):
        out = real(df, what)
        files.extend(out.inputFiles() if what == "sets" else [])
        return out

    monkeypatch.setattr(line_dedup, "written", spied)
    rows = [(1, "a b c d e\nx"), (2, "a b c d e f\nx"), (3, "\n")]
    assert sorted(tuple(r) for r in line_dedup.removed_lines(frame(spark, rows)).collect()) == [(2, 0, False), (2, 1, True)]
    assert files and not any(Path(f.removeprefix("file://")).parent.exists() for f in files)
