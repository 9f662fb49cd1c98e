"""Every query that has SQL gives what DuckDB makes of it; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from quern.plans.registry import ORACLES, QUERIES

DATA = os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def canonical(df):
    df = df[sorted(df.columns)].map(plain)
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = canonical(QUERIES[name](spark, DATA).toPandas()), canonical(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"feature_importance", "transfer", "pair_features", "tsv_to_lists"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_names():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm(tmp_path):
    """The library, its queries and their SQL without the subpackage llm, and with and without the pipeline."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    ask = [sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'pipeline' not in q and len(q) > 50"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run(ask, cwd=tmp_path, env=env, check=False).returncode == 0
    if os.path.exists(f"{root}/corpus_pipeline.py"):
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
        assert subprocess.run(ask, cwd=tmp_path, env=env, check=False).returncode == 0


def test_pair_features(spark):
    got = QUERIES["pair_features"](spark, DATA)
    assert len(got.columns) == 2 + 59 and got.count() == got.select("s1_id", "r_id").distinct().count() > 0


def test_cheap_features(spark):
    from quern.operators import features
    from quern.plans import linkage, tables, text_queries

    r, s1 = tables.vectors(spark, DATA)
    named = text_queries.raw(spark, DATA).select("id", *(c.alias(n) for n, c in text_queries.text.name(text_queries.F.col("name_raw")).items()), *(c.alias(n) for n, c in text_queries.text.address(text_queries.F.col("addr_raw")).items()), (text_queries.F.col("id") % 7 == 0).alias("addr_missing"))
    rs, ss = named.join(r.selectExpr("r_id AS id", "src"), "id"), named.join(s1.selectExpr("s1_id AS id"), "id")
    pairs = linkage.candidates(r, s1)
    cheap, names = features.cheap_features(pairs, rs, ss)
    full, all_names = features.pair_features(pairs, rs.withColumns({"country": text_queries.F.lit("x"), "name_native": text_queries.F.lit(False)}), ss.withColumns({"country": text_queries.F.lit("x"), "name_native": text_queries.F.lit(False)}))
    assert len(names) == 21 and set(names) - set(all_names) == {"name_tset_dr"}
    names.remove("name_tset_dr")
    a, b = (df.select("s1_id", "r_id", *names).toPandas().sort_values(["s1_id", "r_id"], ignore_index=True) for df in (cheap, full))
    pd.testing.assert_frame_equal(a, b)
    assert (a["gap_s1"] >= 0).all() and (a["gap_r"] >= 0).all()


def test_tsv_to_lists(spark):
    got = {r.source1_entity_id: set((r.matched_entity_ids or "").split(",")) - {""} for r in QUERIES["tsv_to_lists"](spark, DATA).collect()}
    assert len(got) == 200
    worth = []
    for s1, own in got.items():
        k = int(s1[3:])
        true = {x for x, some in ((f"S2-{k}", k % 4 != 0), (f"S3-{k}", k % 2 == 0)) if some}
        worth.append(1.0 if not own and not true else 1.25 * len(own & true) / (len(own) + 0.25 * len(true)))
    assert sum(worth) / len(worth) > 0.8
    everyone = [x for own in got.values() for x in own]
    assert len(everyone) == len(set(everyone))
