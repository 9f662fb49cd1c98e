"""The queries of the driver, each beside the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.config import LinkConfig
from quern.functions import hashing
from quern.operators import blocking, context, decision, folds, reports, scoring
from quern.plans import linkage, tables
from quern.sources import records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CONFIG = LinkConfig()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- candidates -------------------------------------------------------------------------------------------

VEC = """
v AS (SELECT vec_id, label AS block, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
r AS (SELECT vec_id AS r_id, block, vec, 2 + vec_id % 2 AS src, vec_id % 7 = 0 AS addr_missing FROM v WHERE vec_id % 5 <> 0),
s AS (SELECT vec_id AS s1_id, block, vec FROM v WHERE vec_id % 5 = 0),
near AS (SELECT r_id, s1_id, round(list_inner_product(r.vec, s.vec), 6) AS cos FROM r JOIN s USING (block)),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY cos DESC, s1_id) - 1 AS rank FROM near) WHERE rank < 10),
top AS (SELECT *, max(cos) OVER (PARTITION BY r_id) AS cos1, coalesce(max(CASE WHEN rank = 1 THEN cos END) OVER (PARTITION BY r_id), -1.0) AS cos2 FROM knn),
gap AS (SELECT * FROM top WHERE round(cos1 - cos, 6) <= 0.25)"""


@query(f"WITH {VEC} SELECT r_id, s1_id, cos, rank FROM knn")
def knn_exact(spark, d):
    return blocking.knn(*tables.vectors(spark, d), CONFIG.k)


@query(f"WITH {VEC} SELECT r_id, s1_id, cos, rank, cos1, cos2 FROM gap")
def knn_gap_pruned(spark, d):
    return linkage.candidates(*tables.vectors(spark, d), CONFIG)


@query(f"""WITH {VEC},
nm AS (SELECT s1_id, block, list_concat(vec[1:32], list_transform(range(32), lambda i: 0.0::DOUBLE)) AS nvec FROM s),
cand AS (SELECT r_id, s1_id, row_number() OVER (PARTITION BY r_id ORDER BY round(list_inner_product(r.vec, nm.nvec), 6) DESC, s1_id) AS k FROM r JOIN nm USING (block) WHERE addr_missing),
new AS (SELECT c.r_id, c.s1_id FROM cand c WHERE k <= 5 AND NOT EXISTS (SELECT 1 FROM gap g WHERE g.r_id = c.r_id AND g.s1_id = c.s1_id)),
al AS (SELECT r_id, s1_id, cos, 0 AS chan FROM gap UNION ALL SELECT n.r_id, n.s1_id, e.cos, 1 FROM new n JOIN near e USING (r_id, s1_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY cos DESC, s1_id) - 1 AS rank FROM al)
SELECT *, max(cos) OVER (PARTITION BY r_id) AS cos1, coalesce(max(CASE WHEN rank = 1 THEN cos END) OVER (PARTITION BY r_id), -1.0) AS cos2 FROM rk""")
def knn_name_channel(spark, d):
    r, s1 = tables.vectors(spark, d)
    names = s1.withColumn("vec", F.concat(F.slice("vec", 1, 32), F.array_repeat(F.lit(0.0), 32)))
    return blocking.name_channel(linkage.candidates(r, s1, CONFIG), r, s1, names, CONFIG.name_k)


@query()
def knn_lsh(spark, d):
    return blocking.knn_lsh(*tables.vectors(spark, d), CONFIG.k, dim=64)


@query()
def knn_probed(spark, d):
    return blocking.knn_probed(*tables.text_vectors(spark, d), CONFIG.k, probes=4)


@query(f"""WITH {VEC},
sc AS (SELECT s1_id, r_id, cos, round((cos + 1) / 2, 6) AS p FROM gap),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY p DESC, cos DESC, s1_id) AS rn FROM sc) WHERE rn = 1),
pre AS (SELECT *, row_number() OVER w AS k, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS ps, sum(p) OVER (PARTITION BY s1_id) AS pa, CASE WHEN max(p) OVER (PARTITION BY s1_id) >= 1 THEN 0 ELSE exp(sum(CASE WHEN p < 1 THEN ln(1 - p) END) OVER (PARTITION BY s1_id)) END AS none FROM ex WINDOW w AS (PARTITION BY s1_id ORDER BY p DESC, cos DESC, r_id)),
ef AS (SELECT *, round(1.25 * ps / (k + 0.25 * pa), 9) AS ef FROM pre),
bk AS (SELECT s1_id, max(ef) AS best, max(none) AS none FROM ef GROUP BY 1),
ch AS (SELECT e.s1_id, min(k) AS kk FROM ef e JOIN bk USING (s1_id) WHERE e.ef = bk.best AND bk.best > round(bk.none, 9) GROUP BY 1),
m AS (SELECT e.s1_id, e.r_id FROM ef e JOIN ch USING (s1_id) WHERE e.k <= ch.kk)
SELECT s.s1_id, coalesce(string_agg(m.r_id::VARCHAR, ',' ORDER BY m.r_id), '') AS matched_ids FROM s LEFT JOIN m USING (s1_id) GROUP BY 1""")
def linkage_end_to_end(spark, d):
    return linkage.linked_lists(*tables.vectors(spark, d), CONFIG)


@query(f"""WITH {VEC} SELECT r_id, s1_id, cos, rank, cos1, cos2, round(CASE WHEN rank = 0 THEN cos - cos2 ELSE cos - cos1 END, 6) AS margin,
count(*) OVER (PARTITION BY r_id) AS n_cand_r, count(*) OVER (PARTITION BY s1_id) AS n_cand_s1, round(max(cos) OVER (PARTITION BY s1_id) - cos, 6) AS gap_s1, row_number() OVER (PARTITION BY s1_id ORDER BY cos DESC, r_id) AS rank_s1 FROM gap""")
def pair_competition(spark, d):
    return rounded(context.competition(linkage.candidates(*tables.vectors(spark, d), CONFIG)), "margin", "gap_s1")


VTRUE = "tr AS (SELECT r_id, min(s1_id) AS s1_id FROM near JOIN (SELECT r_id, max(cos) AS c FROM near GROUP BY 1) b USING (r_id) WHERE near.cos = b.c GROUP BY 1)"


def vector_truth(r: DataFrame, s1: DataFrame) -> DataFrame:
    """For the reports: the nearest S1 of each R."""
    return blocking.knn(r, s1, 1).select("r_id", "s1_id")


@query(f"""WITH {VEC}, {VTRUE}, nm AS (SELECT tr.r_id, min(g.rank) AS rank FROM tr LEFT JOIN (SELECT r_id, s1_id, row_number() OVER (PARTITION BY r_id ORDER BY (s1_id * 7 + r_id) % 11, s1_id) - 1 AS rank FROM gap) g ON g.r_id = tr.r_id AND g.s1_id = tr.s1_id GROUP BY 1)
SELECT k, sum(CASE WHEN rank < k THEN 1 ELSE 0 END)::BIGINT AS found, count(*) AS total, round(sum(CASE WHEN rank < k THEN 1 ELSE 0 END) / count(*), 6) AS recall FROM nm, (VALUES (1), (3), (5), (10)) AS t(k) GROUP BY k""")
def recall_at_k(spark, d):
    r, s1 = tables.vectors(spark, d)
    order = W.partitionBy("r_id").orderBy((F.col("s1_id") * 7 + F.col("r_id")) % 11, "s1_id")
    found = linkage.candidates(r, s1, CONFIG).select("r_id", "s1_id", (F.row_number().over(order) - 1).alias("rank"))
    return rounded(reports.recall_at(found, vector_truth(r, s1), (1, 3, 5, 10)), "recall")


@query(f"""WITH {VEC}, {VTRUE}, n AS (SELECT s1_id, count(*) AS n FROM gap GROUP BY 1),
t AS (SELECT tr.s1_id, count(*) AS nt, count(g.r_id) AS nf FROM tr LEFT JOIN gap g ON g.r_id = tr.r_id AND g.s1_id = tr.s1_id GROUP BY 1),
e AS (SELECT s.s1_id, s.block, coalesce(n, 0) AS n, coalesce(nt, 0) AS nt, coalesce(nf, 0) AS nf FROM s LEFT JOIN n USING (s1_id) LEFT JOIN t USING (s1_id)),
told AS (SELECT block, count(*) AS n_s1, sum(n)::BIGINT AS n_pairs, avg(n) AS mean, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99, max(n) AS max, sum((n = 0)::INT)::BIGINT AS n_without, sum(nf) / nullif(sum(nt), 0) AS pair_completeness, avg(CASE WHEN nt > 0 THEN (nf = nt)::INT END) AS entity_completeness FROM e GROUP BY GROUPING SETS ((block), ())),
sp AS (SELECT block, a, coalesce(b, 0) AS b FROM (SELECT block, count(*) AS a FROM s GROUP BY 1) LEFT JOIN (SELECT block, count(*) AS b FROM r GROUP BY 1) USING (block)),
sg AS (SELECT block, sum(a * b)::BIGINT AS all_pairs FROM sp GROUP BY GROUPING SETS ((block), ()))
SELECT told.block, n_s1, n_pairs, round(mean, 6) AS mean, round(median, 6) AS median, round(p90, 6) AS p90, round(p99, 6) AS p99, max, n_without, round(pair_completeness, 6) AS pair_completeness, round(entity_completeness, 6) AS entity_completeness, all_pairs, round(1 - n_pairs / nullif(all_pairs, 0), 6) AS reduction
FROM told JOIN sg ON told.block IS NOT DISTINCT FROM sg.block""")
def blocking_report(spark, d):
    r, s1 = tables.vectors(spark, d)
    report = reports.blocking_report(linkage.candidates(r, s1, CONFIG), vector_truth(r, s1), s1.select("s1_id", "block"), r.select("r_id", "block"))
    return rounded(report, "mean", "median", "p90", "p99", "pair_completeness", "entity_completeness", "reduction")


# --- decisions --------------------------------------------------------------------------------------------

PAIRS = """
pr AS (SELECT l_partkey AS s1_id, l_orderkey AS r_id, ((l_orderkey * 7919 + l_partkey * 104729) % 1000)::DOUBLE / 1000.0 AS p, round(1 - min(l_tax), 6) AS cos, 2 + l_orderkey % 2 AS src FROM lineitem GROUP BY l_partkey, l_orderkey),
tr AS (SELECT l_orderkey AS r_id, min(l_partkey) AS s1_id FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
ev AS (SELECT p_partkey AS s1_id, p_brand AS country FROM part),
ex AS (SELECT s1_id, r_id, p, cos, src FROM (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY p DESC, cos DESC, s1_id) AS rn FROM pr) WHERE rn = 1)"""


def chosen(source: str, keys: str = "s1_id", name: str = "sel") -> str:
    """CTEs that select the best expected prefix of `source`."""
    on = keys.replace(" ", "").split(",")
    using = ", ".join(on)
    return f"""
{name}_a AS (SELECT *, row_number() OVER w AS k, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS ps, sum(p) OVER (PARTITION BY {keys}) AS pa,
  CASE WHEN max(p) OVER (PARTITION BY {keys}) >= 1 THEN 0 ELSE exp(sum(CASE WHEN p < 1 THEN ln(1 - p) END) OVER (PARTITION BY {keys})) END AS none FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY p DESC, cos DESC, r_id)),
{name}_b AS (SELECT *, round(1.25 * ps / (k + 0.25 * pa), 9) AS ef FROM {name}_a),
{name}_c AS (SELECT {keys}, max(ef) AS best, round(max(none), 9) AS none FROM {name}_b GROUP BY ALL),
{name}_d AS (SELECT {keys}, min(k) AS kk FROM {name}_b JOIN {name}_c c USING ({using}) WHERE ef = c.best AND c.best > c.none GROUP BY ALL),
{name} AS (SELECT b.* EXCLUDE (ps, pa, none) FROM {name}_b b JOIN {name}_d d USING ({using}) WHERE b.k <= d.kk)"""


F05 = "CASE WHEN coalesce(np, 0) = 0 AND coalesce(nt, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(tp, 0) / (coalesce(np, 0) + 0.25 * coalesce(nt, 0)) END"


@query(f"WITH {PAIRS} SELECT s1_id, r_id, p, cos FROM ex")
def exclusive(spark, d):
    return decision.exclusive(tables.pairs(spark, d)).select("s1_id", "r_id", "p", "cos")


@query(f"WITH {PAIRS} SELECT s1_id, r_id, p, cos FROM ex WHERE p >= 0.5")
def select_threshold(spark, d):
    return decision.select_threshold(tables.pairs(spark, d), 0.5).select("s1_id", "r_id", "p", "cos")


@query(f"WITH {PAIRS}, f AS (SELECT * FROM ex WHERE p >= 0.2), {chosen('f')} SELECT s1_id, r_id, p, cos, k, round(ef, 6) AS ef FROM sel")
def select_expected_f(spark, d):
    return rounded(decision.select_expected_f(tables.pairs(spark, d), 0.2).select("s1_id", "r_id", "p", "cos", "k", "ef"), "ef")


SCORED = f"""m AS (SELECT s1_id, r_id FROM ex WHERE p >= 0.5),
c AS (SELECT ev.s1_id, ev.country, (SELECT count(*) FROM m WHERE m.s1_id = ev.s1_id) AS np, (SELECT count(*) FROM tr WHERE tr.s1_id = ev.s1_id) AS nt, (SELECT count(*) FROM m JOIN tr USING (s1_id, r_id) WHERE m.s1_id = ev.s1_id) AS tp FROM ev),
sc AS (SELECT *, {F05} AS f FROM c)"""


@query(f"WITH {PAIRS}, {SCORED} SELECT round(avg(f), 6) AS f05, count(*) AS n FROM sc")
def macro_f05(spark, d):
    return rounded(decision.macro_f(decision.select_threshold(tables.pairs(spark, d), 0.5), tables.truth(spark, d), tables.everyone(spark, d)), "f05")


@query(f"WITH {PAIRS}, {SCORED} SELECT country, round(avg(f), 6) AS f05, count(*) AS n FROM sc GROUP BY GROUPING SETS ((country), ())")
def per_group_f05(spark, d):
    return rounded(decision.grouped_f(decision.select_threshold(tables.pairs(spark, d), 0.5), tables.truth(spark, d), tables.everyone(spark, d), "country"), "f05")


GRID = f"""cfg AS (SELECT 'threshold' AS rule, t::DOUBLE AS param FROM (VALUES {', '.join(f'({t})' for t in CONFIG.thresholds)}) AS x(t) UNION ALL SELECT 'expected', t::DOUBLE FROM (VALUES {', '.join(f'({t})' for t in CONFIG.floors)}) AS y(t)),
tried AS (SELECT rule, param, s1_id, r_id, p, cos FROM ex JOIN cfg ON p >= param), ex_e AS (SELECT * FROM tried WHERE rule = 'expected'), {chosen('ex_e', 'rule, param, s1_id')},
m AS (SELECT rule, param, s1_id, r_id FROM tried WHERE rule = 'threshold' UNION ALL SELECT rule, param, s1_id, r_id FROM sel),
np AS (SELECT rule, param, s1_id, count(*) AS np FROM m GROUP BY ALL), nt AS (SELECT s1_id, count(*) AS nt FROM tr GROUP BY 1), tp AS (SELECT rule, param, s1_id, count(*) AS tp FROM m JOIN tr USING (s1_id, r_id) GROUP BY ALL),
g AS (SELECT rule, param, avg({F05}) AS f05 FROM ev CROSS JOIN cfg LEFT JOIN np USING (rule, param, s1_id) LEFT JOIN nt USING (s1_id) LEFT JOIN tp USING (rule, param, s1_id) GROUP BY ALL)"""


@query(f"WITH {PAIRS}, {GRID} SELECT rule, param, round(f05, 6) AS f05 FROM g")
def rule_grid(spark, d):
    return rounded(decision.rule_grid(tables.pairs(spark, d), tables.truth(spark, d), tables.everyone(spark, d), CONFIG.thresholds, CONFIG.floors), "f05")


@query(f"WITH {PAIRS}, {GRID} SELECT rule, param, round(f05, 6) AS f05 FROM g ORDER BY round(g.f05, 9) DESC, rule DESC, param LIMIT 1")
def best_rule(spark, d):
    return rounded(decision.best_rule(decision.rule_grid(tables.pairs(spark, d), tables.truth(spark, d), tables.everyone(spark, d), CONFIG.thresholds, CONFIG.floors)), "f05")


@query(f"WITH {PAIRS}, m AS (SELECT s1_id, r_id FROM pr SEMI JOIN tr USING (s1_id, r_id)), np AS (SELECT s1_id, count(*) AS np FROM m GROUP BY 1), nt AS (SELECT s1_id, count(*) AS nt FROM tr GROUP BY 1) SELECT round(avg({F05.replace('coalesce(tp, 0)', 'coalesce(np, 0)')}), 6) AS f05, count(*) AS n FROM ev LEFT JOIN np USING (s1_id) LEFT JOIN nt USING (s1_id)")
def ceiling_f05(spark, d):
    return rounded(decision.macro_f(decision.perfect(tables.pairs(spark, d), tables.truth(spark, d)), tables.truth(spark, d), tables.everyone(spark, d)), "f05")


@query("SELECT * FROM (VALUES ('r_matched_twice', 0::BIGINT), ('match_without_candidate', 0), ('unknown_s1', 0)) AS t(\"check\", n)")
def output_contract(spark, d):
    pairs = tables.pairs(spark, d)
    return decision.violations(decision.select_expected_f(pairs, 0.2), pairs, tables.everyone(spark, d))


@query(f"""WITH {PAIRS}, a AS (SELECT *, max(p) OVER (PARTITION BY r_id) AS pmax_r, row_number() OVER (PARTITION BY r_id ORDER BY p DESC, s1_id) AS rank_r, count(*) FILTER (p >= 0.5) OVER (PARTITION BY r_id) AS nconf_r FROM pr),
b AS (SELECT *, coalesce(nth_value(p, 2) OVER (PARTITION BY r_id ORDER BY rank_r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS second_r FROM a)
SELECT s1_id, r_id, p, cos, src, pmax_r, rank_r, nconf_r, second_r, (rank_r = 1)::INT AS is_best_r, round(p - pmax_r, 6) AS gap_r, round(sum(p) OVER (PARTITION BY s1_id), 6) AS psum_s1, round(sum(p) OVER (PARTITION BY s1_id) - p, 6) AS psum_s1_others,
count(*) FILTER (p >= 0.9) OVER (PARTITION BY s1_id) AS nconf_s1, count(*) FILTER (p >= 0.9) OVER (PARTITION BY s1_id, src) AS nconf_s1_src, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, r_id) AS rank_s1, row_number() OVER (PARTITION BY s1_id, src ORDER BY p DESC, r_id) AS rank_s1_src FROM b""")
def cluster_context(spark, d):
    return rounded(context.cluster_context(tables.pairs(spark, d), CONFIG.confident_r, CONFIG.confident_s1), "gap_r", "psum_s1", "psum_s1_others")


@query(f"""WITH {PAIRS}, t AS (SELECT s1_id, r_id AS sibling, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, r_id) AS place FROM pr WHERE p >= 0.9),
o AS (SELECT pr.s1_id, pr.r_id, sibling, row_number() OVER (PARTITION BY pr.s1_id, pr.r_id ORDER BY place) AS k FROM pr JOIN t ON pr.s1_id = t.s1_id AND pr.r_id <> t.sibling WHERE place <= 4)
SELECT s1_id, r_id, sibling FROM o WHERE k <= 3""")
def siblings(spark, d):
    return context.siblings(tables.pairs(spark, d), CONFIG.confident_s1)


@query(f"""WITH {VEC}, pp AS (SELECT s1_id, r_id, (cos + 1) / 2 AS p FROM gap), t AS (SELECT s1_id, r_id AS sibling, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, r_id) AS place FROM pp WHERE p >= 0.7),
o AS (SELECT pp.s1_id, pp.r_id, sibling, row_number() OVER (PARTITION BY pp.s1_id, pp.r_id ORDER BY place) AS k FROM pp JOIN t ON pp.s1_id = t.s1_id AND pp.r_id <> t.sibling WHERE place <= 4),
c AS (SELECT o.s1_id, o.r_id, max(list_inner_product(a.vec, b.vec)) AS m, avg(list_inner_product(a.vec, b.vec)) AS e, count(*) AS n FROM o JOIN r a ON a.r_id = o.r_id JOIN r b ON b.r_id = o.sibling WHERE k <= 3 GROUP BY 1, 2)
SELECT pp.s1_id, pp.r_id, round(m, 6) AS sib_cos_max, round(e, 6) AS sib_cos_mean, coalesce(n, 0) AS n_sib FROM pp LEFT JOIN c USING (s1_id, r_id)""")
def sibling_similarity(spark, d):
    r, s1 = tables.vectors(spark, d)
    scored = linkage.candidates(r, s1, CONFIG).select("s1_id", "r_id", ((F.col("cos") + 1) / 2).alias("p"))
    return rounded(context.sibling_similarity(scored, r, 0.7).drop("p"), "sib_cos_max", "sib_cos_mean")


# --- sources, joins, sets ---------------------------------------------------------------------------------


@query("SELECT c_custkey AS s1_id, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS matched_ids FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey GROUP BY 1")
def id_list(spark, d):
    o = tables.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("s1_id"), F.col("o_orderkey").alias("r_id"))
    return records.id_lists(o, tables.table(spark, d, "customer").select(F.col("c_custkey").alias("s1_id")))


@query("SELECT o_custkey AS s1_id, o_orderkey::VARCHAR AS r_id FROM orders WHERE o_orderstatus = 'F'")
def id_list_explode(spark, d):
    return records.explode_id_list(id_list(spark, d), "s1_id", "matched_ids").join(tables.table(spark, d, "customer").select(F.col("c_custkey").alias("s1_id")), "s1_id", "left_semi")


@query("SELECT c_custkey AS entity_id, c_name AS name_raw, 1 AS src FROM customer UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier UNION ALL SELECT p_partkey, p_name, 3 FROM part")
def union_sources(spark, d):
    parts = [("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")]
    return records.tagged_union({i: tables.table(spark, d, t).select(F.col(k).alias("entity_id"), F.col(n).alias("business_name")) for i, (t, k, n) in enumerate(parts, 1)})


@query("SELECT o_orderkey AS r_id, c_custkey AS s1_id, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_inner(spark, d):
    o, c, n = (tables.table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("r_id"), F.col("c_custkey").alias("s1_id"), "c_name", "n_name")


@query(f"WITH {PAIRS} SELECT pr.s1_id, pr.r_id, pr.p FROM pr JOIN tr ON pr.s1_id = tr.s1_id AND pr.r_id = tr.r_id")
def join_composite(spark, d):
    t = tables.truth(spark, d).select(F.col("s1_id").alias("ts"), F.col("r_id").alias("tr"))
    return tables.pairs(spark, d).join(t, (F.col("s1_id") == F.col("ts")) & (F.col("r_id") == F.col("tr"))).select("s1_id", "r_id", "p")


@query("SELECT c_custkey AS s1_id, coalesce(n, 0) AS n, coalesce(total, 0.0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def join_left_default(spark, d):
    o = tables.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("s1_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("s1_id")).join(o, "s1_id", "left").select("s1_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query(f"WITH {PAIRS} SELECT s1_id, r_id FROM pr WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.s1_id = pr.s1_id AND tr.r_id = pr.r_id)")
def join_anti(spark, d):
    return tables.pairs(spark, d).join(tables.truth(spark, d), ["s1_id", "r_id"], "left_anti").select("s1_id", "r_id")


@query(f"WITH {PAIRS} SELECT s1_id, r_id FROM pr WHERE r_id IN (SELECT r_id FROM tr)")
def join_semi(spark, d):
    return tables.pairs(spark, d).join(tables.truth(spark, d), "r_id", "left_semi").select("s1_id", "r_id")


@query("WITH o AS (SELECT o_custkey AS s1_id, o_orderkey AS r_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT a.s1_id, a.r_id, b.r_id AS sibling FROM o a JOIN o b ON a.s1_id = b.s1_id AND a.r_id <> b.r_id WHERE b.k <= 4")
def join_self_exclusion(spark, d):
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("s1_id"), F.col("o_orderkey").alias("r_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).alias("k"))
    return o.select("s1_id", "r_id").join(o.filter("k <= 4").select("s1_id", F.col("r_id").alias("sibling")), "s1_id").filter("r_id <> sibling")


@query("SELECT o_custkey AS s1_id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_except(spark, d):
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("s1_id"), "o_orderstatus")
    return o.filter("o_orderstatus = 'F'").select("s1_id").subtract(o.filter("o_orderstatus = 'O'").select("s1_id"))


@query("SELECT o_custkey AS s1_id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(spark, d):
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("s1_id"), "o_orderstatus")
    return o.filter("o_orderstatus = 'F'").select("s1_id").intersect(o.filter("o_orderstatus = 'O'").select("s1_id"))


@query("SELECT DISTINCT l_partkey AS s1_id, l_orderkey AS r_id FROM lineitem")
def distinct_pairs(spark, d):
    return tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("s1_id"), F.col("l_orderkey").alias("r_id")).dropDuplicates(["s1_id", "r_id"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, max(l_discount) AS max_discount, min(l_shipdate) AS first_ship, count(DISTINCT l_suppkey) AS n_supp, round(avg((l_tax > 0.04)::INT), 6) AS share_taxed, bool_and(l_quantity > 0) AS all_positive FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2")
def grouped_summary(spark, d):
    li = tables.table(spark, d, "lineitem").filter("l_shipdate >= TIMESTAMP '1996-01-01'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.max("l_discount").alias("max_discount"), F.min("l_shipdate").alias("first_ship"),
        F.count_distinct("l_suppkey").alias("n_supp"), F.round(F.avg((F.col("l_tax") > 0.04).cast("double")), 6).alias("share_taxed"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"),
    )


@query("SELECT o_custkey AS s1_id, o_orderkey AS r_id, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_of_group(spark, d):
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return tables.table(spark, d, "orders").withColumn("k", k).filter("k = 1").select(F.col("o_custkey").alias("s1_id"), F.col("o_orderkey").alias("r_id"), "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def global_top(spark, d):
    return tables.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("SELECT label AS block, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.99), 6) AS p99, round(max(x), 6) AS max FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY 1")
def quantile_summary(spark, d):
    x = tables.table(spark, d, "embeddings").select(F.col("label").alias("block"), F.col("embedding")[0].cast("double").alias("x"))
    return rounded(x.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), *(F.percentile("x", F.lit(q)).alias(n) for q, n in ((0.5, "median"), (0.9, "p90"), (0.99, "p99"))), F.max("x").alias("max")), "mean", "median", "p90", "p99", "max")


# --- folds and samples ------------------------------------------------------------------------------------

CRC = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], list_transform(range(8), lambda k: 0::BIGINT)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t)"


def crc(x: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({x}) + 1), lambda i: unicode(substr({x}, i, 1))::BIGINT)), lambda a, b: xor(crc.t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


REC = f"""{CRC}, own AS (SELECT 'R-' || o_orderkey AS r_id, 'S1-' || o_custkey AS s1_id FROM orders WHERE o_orderstatus <> 'P'),
rec AS (SELECT 'S1-' || c_custkey AS entity_id, c_name AS name_raw, 1 AS src, 'S1-' || c_custkey AS true_s1 FROM customer UNION ALL SELECT 'R-' || o_orderkey, o_orderpriority, 2 + o_orderkey % 2, s1_id FROM orders LEFT JOIN own ON r_id = 'R-' || o_orderkey),
keyed AS (SELECT *, coalesce(true_s1, entity_id) AS cluster FROM rec)"""


def folded(spark, d):
    r, owners = tables.records(spark, d)
    return folds.with_folds(r, owners, CONFIG.buckets)


@query(f"WITH {REC} SELECT entity_id, src, true_s1, ({crc('cluster')} % 10)::INT AS bucket FROM keyed, crc")
def fold_buckets(spark, d):
    return folded(spark, d).select("entity_id", "src", "true_s1", "bucket")


@query(f"WITH {REC} SELECT entity_id, src FROM rec, crc WHERE src <> 1 AND {crc("('train:' || entity_id)")} % 100000 < 25000")
def record_sample(spark, d):
    r, _ = tables.records(spark, d)
    return r.filter(F.col("src") != 1).filter(hashing.in_sample(F.col("entity_id"), 0.25, "train:")).select("entity_id", "src")


@query(f"WITH {REC}, c AS (SELECT count(*) FILTER (src = 1) AS n1, count(*) FILTER (src <> 1) AS nr FROM rec), m AS (SELECT count(*) AS nm FROM own) SELECT round(greatest(0, (12.0 - (nr - nm) / n1) / (nm / n1 + 12.0)), 6) AS fraction FROM c, m")
def density_fraction(spark, d):
    r, owners = tables.records(spark, d)
    return rounded(folds.density_fraction(owners, r, 12.0), "fraction")


@query(f"""WITH {REC}, h AS (SELECT *, CASE WHEN true_s1 IS NULL THEN 100000 ELSE {crc("('densify:' || true_s1)")} % 100000 END AS h FROM keyed, crc)
SELECT entity_id, src, CASE WHEN h >= 30000 THEN true_s1 END AS true_s1 FROM h WHERE src <> 1 OR h >= 30000""")
def densify(spark, d):
    return folds.densified(folded(spark, d), 0.3).select("entity_id", "src", "true_s1")


@query(f"WITH {REC} SELECT entity_id, src FROM keyed, crc WHERE {crc('cluster')} % 1000 < 200")
def hash_sample(spark, d):
    return folds.cluster_sample(folded(spark, d), 0.2).select("entity_id", "src")


@query(f"WITH {REC} SELECT entity_id, src FROM keyed WHERE cluster IN (SELECT cluster FROM keyed WHERE regexp_matches(name_raw, '^Customer#0+[0-9]*7$'))")
def slice_by_regex(spark, d):
    return folds.slice_by_regex(folded(spark, d), "^Customer#0+[0-9]*7$", "name_raw").select("entity_id", "src")


# --- scores -----------------------------------------------------------------------------------------------

PY = f"{PAIRS}, {CRC}, py AS (SELECT pr.*, (tr.r_id IS NOT NULL)::INT AS y, ({crc('pr.s1_id::VARCHAR')} % 10)::INT AS bucket, ((pr.r_id * 31 + pr.s1_id * 17) % 997)::DOUBLE / 997 AS pb FROM crc, pr LEFT JOIN tr ON tr.r_id = pr.r_id AND tr.s1_id = pr.s1_id)"


def labelled(spark, d):
    y = tables.truth(spark, d).withColumn("y", F.lit(1))
    df = tables.pairs(spark, d).join(y, ["s1_id", "r_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return df.withColumns({"bucket": hashing.bucket(F.col("s1_id"), 10), "pb": ((F.col("r_id") * 31 + F.col("s1_id") * 17) % 997).cast("double") / 997})


@query(f"WITH {PY} SELECT s1_id, r_id, bucket, round(CASE WHEN bucket IN (6, 7, 8, 9) THEN p WHEN bucket IN (2, 3, 4, 5) THEN pb ELSE (p + pb) / 2 END, 6) AS p FROM py")
def cross_fit_scores(spark, d):
    return rounded(labelled(spark, d).select("s1_id", "r_id", "bucket", scoring.cross_fit(F.col("bucket"), F.col("p"), F.col("pb"), CONFIG.fold_a, CONFIG.fold_b).alias("p")), "p")


@query(f"""WITH {PY}, sc AS (SELECT s1_id, r_id, bucket, 'a' AS model, p AS score FROM py UNION ALL SELECT s1_id, r_id, bucket, 'b', pb FROM py UNION ALL SELECT s1_id, r_id, bucket, 'c', p * pb FROM py),
ms AS (SELECT * FROM (VALUES ('a', [2, 3, 4, 5], [0]), ('b', [6, 7, 8, 9], [0]), ('c', [1, 2, 6], [0])) AS t(model, seen, shared))
SELECT s1_id, r_id, bucket, round(avg(CASE WHEN bucket < 0 OR list_contains(shared, bucket) OR NOT list_contains(seen, bucket) THEN score END), 6) AS score FROM sc JOIN ms USING (model) GROUP BY 1, 2, 3""")
def eligible_mean(spark, d):
    df = labelled(spark, d)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), c.alias("score")) for m, c in (("a", F.col("p")), ("b", F.col("pb")), ("c", F.col("p") * F.col("pb"))))))
    models = spark.createDataFrame([("a", [2, 3, 4, 5], [0]), ("b", [6, 7, 8, 9], [0]), ("c", [1, 2, 6], [0])], "model string, seen array<int>, shared array<int>")
    return rounded(scoring.eligible_mean(df.select("s1_id", "r_id", "bucket", each.alias("x")).select("s1_id", "r_id", "bucket", "x.*"), models), "score")


@query(f"WITH {PY}, parts AS (SELECT s1_id, r_id, p AS total, 1 AS n FROM py UNION ALL SELECT s1_id, r_id, pb + p, 2 FROM py WHERE bucket < 7) SELECT s1_id, r_id, round(sum(total) / sum(n), 6) AS score FROM parts GROUP BY 1, 2")
def partial_merge(spark, d):
    df = labelled(spark, d)
    parts = [df.select("s1_id", "r_id", F.col("p").alias("total"), F.lit(1).alias("count")), df.filter("bucket < 7").select("s1_id", "r_id", (F.col("pb") + F.col("p")).alias("total"), F.lit(2).alias("count"))]
    return rounded(scoring.merged(parts), "score")


@query(f"WITH {PY} SELECT s1_id, r_id, CASE WHEN bucket < 5 THEN p ELSE pb END AS score FROM py")
def score_reuse(spark, d):
    df = labelled(spark, d)
    known = df.filter("bucket < 5").select("s1_id", "r_id", F.col("p").alias("score"))
    return scoring.reused(df.select("s1_id", "r_id", "pb"), known, lambda new: new.withColumn("score", F.col("pb"))).select("s1_id", "r_id", "score")


@query(f"WITH {PY}, q AS (SELECT y, p, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM py) SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy, count(*) AS n FROM q")
def logloss(spark, d):
    return rounded(labelled(spark, d).agg(*(c.alias(n) for n, c in scoring.log_loss(F.col("y"), F.col("p")).items())), "log_loss", "accuracy")


@query(f"WITH {PY}, z AS (SELECT s1_id, r_id, y, round(1 / (1 + exp(-(2.0 * p - 0.5 * pb + 0.3 * cos))), 9) AS p1 FROM py), t AS (SELECT quantile_cont(p1, 1 - 0.9995) AS t1 FROM z WHERE y = 1) SELECT s1_id, r_id, round(p1, 6) AS p1 FROM z, t WHERE p1 >= t1")
def prefilter_linear(spark, d):
    z = labelled(spark, d).select("s1_id", "r_id", "y", F.round(scoring.sigmoid(2.0 * F.col("p") - 0.5 * F.col("pb") + 0.3 * F.col("cos")), 9).alias("p1"))
    return rounded(scoring.prefiltered(z, "p1", "y", CONFIG.kept_share).select("s1_id", "r_id", "p1"), "p1")


PAIR_FEATURES = ["p", "pb", "cos"]


def cross_scored(spark, d, kind="gbt"):
    """Two models, each trained on one fold and scoring the other."""
    df = labelled(spark, d)
    a, b = (scoring.fit(df.filter(F.col("bucket").isin(*fold)), PAIR_FEATURES, kind=kind, rounds=5) for fold in (CONFIG.fold_a, CONFIG.fold_b))
    return scoring.cross_fitted(df.select("s1_id", "r_id", "src", "y", "bucket", "pb", "cos", "p"), a, b, PAIR_FEATURES, CONFIG.fold_a, CONFIG.fold_b)


@query()
def prefilter_gbt(spark, d):
    return scoring.prefiltered(cross_scored(spark, d), "p", "y", CONFIG.kept_share).select("s1_id", "r_id", F.col("p").alias("p1"))


@query()
def stage2_gbt(spark, d):
    """Scores, re-scored with the context that they make."""
    first = cross_scored(spark, d, "linear")
    df = context.cluster_context(first, CONFIG.confident_r, CONFIG.confident_s1)
    names = ["p", "pmax_r", "rank_r", "second_r", "gap_r", "is_best_r", "psum_s1_others", "nconf_s1", "rank_s1"]
    a, b = (scoring.fit(df.filter(F.col("bucket").isin(*fold)), names, rounds=5) for fold in (CONFIG.fold_a, CONFIG.fold_b))
    return scoring.cross_fitted(df, a, b, names, CONFIG.fold_a, CONFIG.fold_b).select("s1_id", "r_id", "p")


@query()
def transfer(spark, d):
    """A model of one country's pairs decides another's; the brands are two countries."""
    half = F.when(F.substring("country", 7, 1) < "3", "A").otherwise("B").alias("country")
    everyone = tables.everyone(spark, d).select("s1_id", half)
    df = labelled(spark, d).join(everyone, "s1_id")
    return rounded(linkage.transfer(df.withColumn("q", F.col("p")), tables.truth(spark, d).select("s1_id", "r_id"), everyone, ["q", "pb", "cos"], "country", [("A", "B"), ("B", "A")]), "f05")


@query()
def feature_importance(spark, d):
    model = scoring.fit(labelled(spark, d), PAIR_FEATURES, rounds=5)
    return spark.createDataFrame(scoring.importance(model, PAIR_FEATURES, 5), "feature string, gain double")


@query()
def external_scorer(spark, d):
    """The hook for a scorer from outside, here the mean of two columns."""
    return scoring.external(labelled(spark, d).select("s1_id", "r_id", "p", "pb"), lambda: lambda b: b.assign(ce=(b["p"] + b["pb"]) / 2)[["s1_id", "r_id", "ce"]], "s1_id long, r_id long, ce double")
