"""Linkage from vectors, or from raw records, to id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import LinkConfig
from quern.functions import similarity, text
from quern.functions.hashing import bucket
from quern.operators import blocking, context, decision, dictionaries, features, scoring, vectors
from quern.sources.records import RECORD, id_lists, read_tsv, tagged_union, write_tsv
from quern.sources.scratch import parquet


def candidates(r: DataFrame, s1: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Nearest neighbours in the block, without those far below the best."""
    return blocking.gap_pruned(blocking.knn(r, s1, config.k), config.max_gap)


def link(r: DataFrame, s1: DataFrame, config: LinkConfig = LinkConfig(), floor: float = 0.0) -> DataFrame:
    """Matches (s1_id, r_id, p, cos): candidates, scored by their cosine, each R at most once, chosen by expected F0.5."""
    scored = candidates(r, s1, config).withColumn("p", F.round((F.col("cos") + 1) / 2, 6))
    return decision.select_expected_f(scored.select("s1_id", "r_id", "p", "cos"), floor)


def linked_lists(r: DataFrame, s1: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """One row for each S1: the ids matched to it, joined by commas."""
    return id_lists(link(r, s1, config), s1)


STAGE2 = [
    "cos", "rank", "margin", "p1", "name_tsort", "core_eq", "addr_tset", "num_jaccard", "num_ratio", "r_missing", "s_missing", "s1_name_freq", "src_r",
    "p", "pmax_r", "rank_r", "nconf_r", "second_r", "gap_r", "is_best_r", "psum_s1", "psum_s1_others", "nconf_s1", "nconf_s1_src", "rank_s1", "rank_s1_src",
    "sib_cos_max", "sib_cos_mean", "n_sib", "sib_name_max", "sib_addr_max",
]


def learned(raw: DataFrame, truth: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """The dictionary of native tokens (token, to, score) of the true pairs outside both folds, so that no fold has seen its own. raw: (entity_id, name_raw, addr_raw), truth: (s1_id, r_id)."""
    own = truth.filter(~bucket(F.col("s1_id"), config.buckets).isin(*config.fold_a, *config.fold_b))
    side = lambda key, p: raw.select(F.col("entity_id").alias(key), F.col("name_raw").alias(f"{p}_name"), F.col("addr_raw").alias(f"{p}_addr"))
    pairs = own.join(side("r_id", "r"), "r_id").join(side("s1_id", "s1"), "s1_id")
    return dictionaries.token_dictionary(dictionaries.paired_tokens(pairs, [("r_name", "s1_name"), ("r_addr", "s1_addr")]), "native", "latin")


def prepared(raw: DataFrame, tokens: DataFrame | None = None, synonyms: Column | None = None) -> DataFrame:
    """Raw records (entity_id, country, name_raw, addr_raw, src) with a number and what the linkage compares. tokens: a dictionary (token, to)."""
    df = raw.withColumn("name_native", text.is_native(F.coalesce("name_raw", F.lit(""))))
    for column in ("name_raw", "addr_raw") if tokens is not None else ():
        df = dictionaries.put_in(df, "entity_id", column, tokens)
    made = {**text.name(F.col("name_raw")), **text.address(F.col("addr_raw"), synonyms)}
    told = df.select("entity_id", "country", "src", "name_native", *(c.alias(n) for n, c in made.items())).withColumn("addr_missing", F.col("addr") == "")
    return parquet(told.withColumn("id", F.monotonically_increasing_id()), "records")


def scored(records: DataFrame, truth: DataFrame, config: LinkConfig = LinkConfig(), rounds: int = 20) -> DataFrame:
    """Candidates (s1_id, r_id, p, cos, bucket, y) of prepared records, by their numbers, scored in stages: neighbours within a country, the prefilter on cheap features, all features, and the context that the scores make.

    Each stage has two models, each of which scores the fold that it wasn't trained on. truth: (s1_id, r_id) by entity id.
    """
    with_vectors = parquet(records.select("id", F.col("country").alias("block"), "src", "addr_missing", vectors.hashed(F.concat_ws(" ", "name", "addr")).alias("vec")), "vectors")
    r = with_vectors.filter("src <> 1").select(F.col("id").alias("r_id"), "block", "vec", "src", "addr_missing")
    s1 = with_vectors.filter("src = 1").select(F.col("id").alias("s1_id"), "block", "vec")
    number = lambda key: records.select(F.col("entity_id").alias(key), F.col("id").alias(f"n_{key}"))
    true = truth.join(number("r_id"), "r_id").join(number("s1_id"), "s1_id").select(F.col("n_r_id").alias("r_id"), F.col("n_s1_id").alias("s1_id"), F.lit(1).alias("y"))
    folds = records.filter("src = 1").select(F.col("id").alias("s1_id"), bucket(F.col("entity_id"), config.buckets).alias("bucket"))
    pairs = candidates(r, s1, config).join(true, ["r_id", "s1_id"], "left").withColumn("y", F.coalesce("y", F.lit(0))).join(folds, "s1_id")
    pairs = parquet(pairs, "candidates")
    rs, ss = records.filter("src <> 1"), records.filter("src = 1")

    def cross(df: DataFrame, names: list[str], kind: str) -> DataFrame:
        a, b = (scoring.fit(df.filter(F.col("bucket").isin(*fold)), names, kind=kind, rounds=rounds) for fold in (config.fold_a, config.fold_b))
        return scoring.cross_fitted(df, a, b, names, config.fold_a, config.fold_b)

    cheap, names = features.cheap_features(pairs, rs, ss)
    kept = scoring.prefiltered(parquet(cross(parquet(cheap, "cheap-features"), names, "linear"), "prefilter"), "p", "y", config.kept_share)
    pairs = parquet(pairs.join(kept.select("r_id", "s1_id", F.col("p").alias("p1")), ["r_id", "s1_id"]), "kept")
    wide, names = features.pair_features(pairs, rs, ss)
    first = parquet(cross(parquet(wide, "pair-features"), names, "gbt").withColumn("src", F.col("src_r").cast("int")), "scores")
    around = context.cluster_context(first.select("s1_id", "r_id", "p", "src"), config.confident_r, config.confident_s1).drop("src", "p")
    texts = lambda c: rs.select(F.col("id").alias("r_id"), F.col(c).alias("text"))
    scores = first.select("s1_id", "r_id", "p")
    near = context.sibling_similarity(scores, r, config.confident_s1).drop("p")
    name, addr = (context.sibling_texts(scores, texts(c), config.confident_s1).select("s1_id", "r_id", F.col("sib_tset_max").alias(n)) for c, n in (("name_core", "sib_name_max"), ("addr", "sib_addr_max")))
    base = first.drop("rank_s1", "gap_r")  # names that the context has too
    second = base.join(around, ["s1_id", "r_id"]).join(near, ["s1_id", "r_id"]).join(name, ["s1_id", "r_id"]).join(addr, ["s1_id", "r_id"])
    second = parquet(second.select("s1_id", "r_id", "y", "bucket", *STAGE2), "stage2")
    return cross(second, STAGE2, "gbt").select("s1_id", "r_id", "p", "cos", "bucket", "y")


def lists_from_records(raw: DataFrame, truth: DataFrame, config: LinkConfig = LinkConfig(), floor: float = 0.0, rounds: int = 20) -> DataFrame:
    """One row for each S1 record (source1_entity_id, matched_entity_ids) of raw records (entity_id, country, name_raw, addr_raw, src; S1 is src 1), chosen by expected F0.5."""
    records = prepared(raw, parquet(learned(raw, truth, config).select("token", "to"), "tokens"))
    chosen = decision.select_expected_f(scored(records, truth, config, rounds).select("s1_id", "r_id", "p", "cos"), floor)
    named = lambda key, out: records.select(F.col("id").alias(key), F.col("entity_id").alias(out))
    pairs = chosen.join(named("s1_id", "source1_entity_id"), "s1_id").join(named("r_id", "matched"), "r_id").select("source1_entity_id", "matched")
    return id_lists(pairs, records.filter("src = 1").select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "matched", "matched_entity_ids")


def run(spark: SparkSession, sources: dict[int, str], truth: str, out: str, config: LinkConfig = LinkConfig(), rounds: int = 20) -> DataFrame:
    """From TSV files to a TSV of lists: sources by number (1 is S1) with the columns of RECORD, truth (source1_entity_id, matched_entity_ids). Returns what it wrote."""
    raw = tagged_union({k: read_tsv(spark, path, RECORD) for k, path in sources.items()})
    known = read_tsv(spark, truth).select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("r_id")).filter("r_id <> ''")
    write_tsv(lists_from_records(parquet(raw, "raw"), parquet(known, "truth"), config, rounds=rounds), out)
    return read_tsv(spark, out)


def transfer(pairs: DataFrame, truth: DataFrame, everyone: DataFrame, names: list[str], group: str, turns: list[tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """(trained_on, tested_on, f05, n): a model of one group's pairs decides those of another. pairs: (s1_id, r_id, cos, y, group, names), everyone: (s1_id, group)."""
    out = None
    for train, test in turns:
        model = scoring.fit(pairs.filter(F.col(group) == train), names, kind="linear")
        told = scoring.scored(pairs.filter(F.col(group) == test), model, names, "p")
        own = everyone.filter(F.col(group) == test).select("s1_id")
        one = decision.macro_f(decision.select_threshold(told.select("s1_id", "r_id", "p", "cos"), threshold), truth.join(own, "s1_id", "left_semi"), own).select(F.lit(train).alias("trained_on"), F.lit(test).alias("tested_on"), "f05", "n")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no turns")
    return out
