"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests (operator 9). DataFrame and SQL functions only.

A text's paragraphs are its lines, in parts of at most PARAGRAPH code points, and its digests their
distinct 64-bit hashes. A sketch has three tables of cells; each digest is in one cell of each. A cell
holds how many digests it got, and the exclusive or of them and of their check hashes. Two sketches
subtract cell by cell, which removes what both have. A cell with one digest left, as its check hash
proves, gives that digest; removing it from its other cells may free more of them. If cells are left
over, larger sketches are made of the two and peeled again.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import partitions, text_or_empty, written

PARAGRAPH = 128
#: Cells of a table of the fingerprint, rounds of its peeling, and how much larger each retry is.
CELLS, ROUNDS, GROWTH = 8, 8, 32
#: Rounds, each of all three tables, of a retry; what so many retries don't recover is compared without sketches.
RETRY_ROUNDS, RETRIES = 5, 5
#: Ranges of ids at least, and how many cuts between them are looked through together.
RANGES, GROUP = 64, 64


def cell(x: Column, table: int, cells: int) -> Column:
    return (F.pmod(F.xxhash64(x, F.lit(table + 1)), F.lit(cells)) + table * cells).cast("int")


def check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(77)).bitwiseAND(0xFFFFFFFF)


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PARAGRAPH}}}"), F.lit(0)), lambda p: F.xxhash64(p)))


def sketch(keys: Column, cells: int = CELLS) -> Column:
    """The cells' (c, k, h) of an array of digests."""
    placed = F.transform(keys, lambda x: F.struct(x.alias("k"), check(x).alias("h"), *(cell(x, t, cells).alias(f"i{t}") for t in range(3))))
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def table(xs: Column, t: int) -> Column:
        return F.transform(F.sequence(F.lit(t * cells), F.lit((t + 1) * cells - 1)), lambda i: F.aggregate(xs, zero, lambda a, x: F.when(x[f"i{t}"] == i, F.struct((a["c"] + 1).alias("c"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h"))).otherwise(a)))

    return F.transform(F.array(placed), lambda xs: F.concat(*(table(xs, t) for t in range(3))))[0]  # computes `placed` once


def printed(cells: Column, n: Column) -> Column:
    return F.concat_ws(";", n.cast("string"), F.array_join(F.transform(cells, lambda x: F.concat_ws(".", x["c"].cast("string"), F.lower(F.hex(x["k"])), F.lower(F.hex(x["h"])))), ","))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def pure(x: Column) -> Column:
    return (F.abs(x["c"]) == 1) & (x["h"] == check(x["k"]))


def peeled(cells: Column, size: int = CELLS, rounds: int = ROUNDS) -> Column:
    """(cells, more, less): what is left of subtracted cells, and how many digests were only in the first and only in the second."""

    def once(state: Column) -> Column:
        found = F.array_distinct(F.transform(F.filter(state["cells"], pure), lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"))))
        placed = F.transform(found, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"), check(x["k"]).alias("h"), *(cell(x["k"], t, size).alias(f"i{t}") for t in range(3))))

        def without(ys: Column) -> Column:
            return F.transform(
                state["cells"],
                lambda x, i: F.aggregate(
                    ys, x, lambda a, y: F.when((y["i0"] == i) | (y["i1"] == i) | (y["i2"] == i), F.struct((a["c"] - y["c"]).alias("c"), a["k"].bitwiseXOR(y["k"]).alias("k"), a["h"].bitwiseXOR(y["h"]).alias("h"))).otherwise(a)
                ),
            )

        return F.transform(
            F.array(placed),
            lambda ys: F.when(F.size(ys) == 0, state).otherwise(
                F.struct(without(ys).alias("cells"), (state["more"] + F.size(F.filter(ys, lambda y: y["c"] == 1))).alias("more"), (state["less"] + F.size(F.filter(ys, lambda y: y["c"] == -1))).alias("less"))
            ),
        )[0]

    start = F.struct(cells.alias("cells"), F.lit(0).alias("more"), F.lit(0).alias("less"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: once(state))


def empty(cells: Column) -> Column:
    return F.forall(cells, lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0))


def likeness(n: Column, m: Column, more: Column) -> Column:
    """The Jaccard similarity of n and m digests of which `more` are only among the n."""
    return F.when((n == 0) & (m == 0), 1.0).otherwise((n - more) / (m + more))


def retried(pairs: DataFrame, cells: int) -> DataFrame:
    """(pair, more, left) of pairs (pair, a, b) of digest arrays by sketches with `cells` cells a table.

    Cells are rows here, only those that aren't zero, so a table's size costs nothing. All rows of a pair
    stay in the partition that the pair is dealt to. Tables are peeled in turn, since a digest is in one cell of
    each and so is never removed twice. Cell -1 counts the digests found on the first side, -2 is there
    for pairs without differences.
    """
    dealt = pairs.repartition(partitions(pairs.sparkSession), "pair")
    signed = dealt.select("pair", F.explode(F.concat(F.transform("a", lambda x: F.struct(x.alias("k"), F.lit(1).alias("c"))), F.transform("b", lambda x: F.struct(x.alias("k"), F.lit(-1).alias("c"))))).alias("x"))

    def entry(i: Column, c: Column, k: Column, h: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), c.cast("int").alias("c"), k.cast("long").alias("k"), h.cast("long").alias("h"))

    def summed(rows: DataFrame) -> DataFrame:
        out = rows.groupBy("pair", "x.i").agg(F.sum("x.c").cast("int").alias("c"), F.bit_xor("x.k").alias("k"), F.bit_xor("x.h").alias("h"))
        return out.filter("c <> 0 OR k <> 0 OR h <> 0")

    k, c = F.col("x.k"), F.col("x.c")
    state = summed(signed.select("pair", F.explode(F.array(*(entry(cell(k, t, cells), c, k, check(k)) for t in range(3)))).alias("x")))
    for step in range(3 * RETRY_ROUNDS):
        t = step % 3
        i, c, k, h = (F.col(n) for n in ("i", "c", "k", "h"))
        alone = (F.floor(i / F.lit(cells)) == t) & (F.abs(c) == 1) & (h == check(k))
        others = [entry(cell(k, u, cells), -c, k, h) for u in range(3) if u != t]
        tally = entry(F.lit(-1), F.when(c == 1, 1).otherwise(0), F.lit(0), F.lit(0))
        state = summed(state.select("pair", F.explode(F.when(alone, F.array(tally, *others)).otherwise(F.array(entry(i, c, k, h)))).alias("x")))
    told = state.groupBy("pair").agg(F.sum(F.when(F.col("i") == -1, F.col("c")).otherwise(0)).alias("more"), F.sum(F.when(F.col("i") >= 0, 1).otherwise(0)).alias("left"))
    return dealt.select("pair").join(told, "pair", "left").select("pair", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("left", F.lit(0)).alias("left"))


def measure(docs: DataFrame) -> Column:
    """A number that rises with the id: a number's own; of other types' text the six bytes after what all ids begin with."""
    kind = docs.schema["id"].dataType
    if isinstance(kind, T.NumericType):
        return F.col("id")
    if not isinstance(kind, T.StringType):
        return F.col("id").cast("timestamp").cast("double") if isinstance(kind, (T.DateType, T.TimestampType)) else F.lit(0)
    ends = docs.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    shared = len(os.path.commonprefix([(ends["a"] or "").encode(), (ends["b"] or "").encode()]))
    return F.conv(F.rpad(F.hex(F.substring(F.encode("id", "utf-8"), shared + 1, 6)), 12, "0"), 16, 10).cast("long")


def buckets(docs: DataFrame, n: int) -> Column:
    """An even, ascending number for ids: of n ranges between quantiles, so many lists of GROUP cuts, that which holds the id. Rows of one id, null too, share it."""
    number = measure(docs).cast("double")
    n = max(RANGES, n)
    q = docs.agg(F.percentile_approx(number, [i / n for i in range(1, n)], 20 * n)).first()[0]
    cuts = sorted(set(q or []))
    if not cuts:
        return F.when(F.col("id").isNull(), -1).otherwise(0)
    groups = [cuts[i : i + GROUP] for i in range(0, len(cuts), GROUP)]
    heads = _doubles([g[0] for g in groups])
    # At most a list of n / GROUP cuts and one of GROUP are looked through for a row, not all n.
    group = F.greatest(F.lit(1), _reached(heads, number))
    place = (group - 1) * GROUP + _reached(F.element_at(F.array(*map(_doubles, groups)), group), number)
    return F.when(F.col("id").isNull(), -1).otherwise(place).cast("int")


def _doubles(values: list[float]) -> Column:
    """A constant array, as text, so that a plan has one literal for it and not one a value."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _reached(cuts: Column, number: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= number))


def with_next(docs: DataFrame, n: int, made) -> DataFrame:
    """Adds to (id, text) next_text and next_keys, of the row that follows by id (and text), after the last the first.

    Ids are dealt to buckets of ranges. The first row of each also goes to the bucket before, as a guest;
    so the row that follows is always in the same bucket, and no task sorts all rows.
    made: the digests of a text.
    """
    bucketed = docs.withColumn("bucket", buckets(docs, n))
    firsts = bucketed.groupBy("bucket").agg(F.min("id").alias("first_id"))
    order = W.orderBy("bucket")  # a row a bucket
    before = firsts.select("first_id", F.col("bucket").alias("own"), F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("before"))
    host = bucketed.join(F.broadcast(before), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("bucket") == F.col("own")), "left")
    both = host.select("id", "text", F.explode(F.when(F.col("before").isNull(), F.array(F.struct("bucket", F.lit(False).alias("guest")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))))).alias("at"))
    dealt = both.select("id", "text", "at.bucket", "at.guest").repartition(partitions(docs.sparkSession), "bucket").withColumn("keys", made(F.col("text")))
    row = W.partitionBy("bucket").orderBy("guest", F.col("id").asc_nulls_first(), "text")
    return dealt.withColumns({"next_text": F.lead("text").over(row), "next_keys": F.lead("keys").over(row)}).filter("NOT guest")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many, or all, of the
    next text by ascending id (ties by text; after the last the first). A null text is an empty one;
    two texts without paragraphs are alike (1.0). A fingerprint is the number of digests and the cells of the
    sketch, so equal texts have equal ones. Likeness is the Jaccard similarity of the digests, from the
    differences that peeling recovers; pairs whose fingerprints hold too many go on to larger sketches.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    n_chars = F.char_length("text")
    quarter = F.floor(n_chars / F.lit(4)).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n_chars - quarter), F.col("next_text").substr(F.lit(1), quarter))
    rows = with_next(docs, 4 * partitions(spark), digests).select("id", n_chars.cast("long").alias("n_chars"), "keys", "next_keys", edited.alias("edited"))
    rows = rows.select("id", "n_chars", "keys", "next_keys", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited_keys"))
    rows = rows.withColumns({f"{x}cells": sketch(F.col(f"{x}keys")) for x in ("", "edited_", "next_")})
    for x in ("edited", "next"):
        rows = rows.withColumn(f"p_{x}", peeled(minus(F.col("cells"), F.col(f"{x}_cells"))))
    near = {f"near_{x}": F.when(empty(F.col(f"p_{x}.cells")), likeness(F.size("keys"), F.size(f"{x}_keys"), F.col(f"p_{x}.more"))) for x in ("edited", "next")}
    rows = rows.select("id", "n_chars", "edited_sha256", printed(F.col("cells"), F.size("keys")).alias("fingerprint"), printed(F.col("edited_cells"), F.size("edited_keys")).alias("edited_fingerprint"), "keys", "edited_keys", "next_keys", *(c.alias(n) for n, c in near.items()))
    kept = F.col("near_edited").isNull() | F.col("near_next").isNull()
    base = rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.when(kept, F.col("keys")).alias("keys"), *(F.when(F.col(f"near_{x}").isNull(), F.col(f"{x}_keys")).alias(f"{x}_keys") for x in ("edited", "next")),
    )
    base = written(base, "fingerprints")
    # A pair is a row and which of its two likenesses: 2 * row, and one more for the next document's.
    pairs = base.select(F.explode(F.filter(F.array(*(F.struct((2 * F.col("row") + i).alias("pair"), F.col("keys").alias("a"), F.col(f"{x}_keys").alias("b")) for i, x in enumerate(("edited", "next")))), lambda p: p["b"].isNotNull())).alias("p")).select("p.*")
    cells, found = CELLS, None
    for _ in range(RETRIES):
        cells *= GROWTH
        got = written(retried(pairs, cells), "retried")
        done = got.filter("left = 0").select("pair", "more")
        found = done if found is None else found.unionByName(done)
        failed = got.filter("left > 0").select("pair")
        if failed.isEmpty():
            break
        pairs = written(pairs.join(failed, "pair", "left_semi"), "failed")
    else:  # an accident of hashes: the digests themselves are compared
        found = found.unionByName(pairs.select("pair", F.size(F.array_except("a", "b")).alias("more")))
    by_row = found.groupBy(F.expr("pair div 2").alias("row")).agg(*(F.max(F.when(F.col("pair") % 2 == i, F.col("more"))).alias(f"more_{x}") for i, x in enumerate(("edited", "next"))))
    # Keys stay behind in `base`; what is joined are rows of a few hundred bytes.
    sizes = base.select("row", "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.size("keys").alias("n"), F.size("edited_keys").alias("n_edited"), F.size("next_keys").alias("n_next"))
    told = sizes.join(by_row, "row", "left")
    return told.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        *(F.coalesce(f"near_{x}", likeness(F.col("n"), F.col(f"n_{x}"), F.col(f"more_{x}"))).alias(f"near_{x}") for x in ("edited", "next")),
    )
