"""Line deduplication by an exact set-similarity join (operator 3). DataFrame functions only."""

from __future__ import annotations

from struct import unpack_from

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import fresh, text_or_empty, written
from quern.sources.scratch import delete

#: Binary logarithms of the sizes of two tables that go to each task, whatever the corpus: the bins in which words are counted, and longs of bits for what to read again.
BINS, BITS = 20, 16
#: A token of more lines than this is hot: its lines are compared with the first of them before they are with each other.
HOT = 4096
#: Lines of so many tokens have parities of 128 bits, others of 64: those of more tokens say less.
LONG = 80
#: Bits of a token's number that its hash takes; those above are its rarity.
HASH = 56


def words(line: Column) -> Column:
    """Runs without spaces, tabs and carriage returns, and "" for each additional one of these."""
    plain = F.when(F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")), F.translate(line, "\t\r", "  ")).otherwise(line)
    return F.split(plain, " ")


def code(n: int) -> int:
    """A count by its logarithm, in 4 bits; 0 for a word that occurs once at most."""
    return min(15, max(0, int(n).bit_length() - 1))


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BINS)


def hashes(line: Column) -> Column:
    """Those of the distinct words, sorted."""
    return F.sort_array(F.array_distinct(F.array_remove(F.transform(words(line), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))))


def rarities(texts: DataFrame) -> bytes:
    """Of each bin of words the `code` of how often they occur in all texts, or in the sets `hashes`: never less than that of one of its words.

    The counts are one row of a count-min sketch, which tasks fill each by itself and which are added up as
    2**BINS numbers. What is read here is its public layout: 20 bytes of sizes, a factor, the counts.
    """
    if "hashes" in texts.columns:
        each = texts.select(F.explode("hashes").alias("h"))
    else:
        each = texts.select(F.explode(words(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")).filter("w <> ''").select(F.xxhash64("w").alias("h"))
    sketch = each.select(bin_of(F.col("h")).alias("bin")).agg(F.count_min_sketch("bin", F.lit(2.0 / (1 << BINS)), F.lit(0.5), F.lit(1)).alias("s")).first()["s"]
    depth, width = unpack_from(">ii", sketch, 12)
    if depth != 1 or len(sketch) != 28 + 8 * width:
        raise RuntimeError("the sketch isn't one row of counts")
    (factor,) = unpack_from(">q", sketch, 20)
    counts = np.frombuffer(sketch, ">i8", offset=28)
    codes = sum((counts >= 1 << c).astype(np.uint8) for c in range(1, 16))  # `code` of each
    product = np.arange(1 << BINS, dtype=np.int64) * np.int64(factor)  # longs overflow
    return codes[((product + (product >> 32)) & 0x7FFFFFFF) % width].tobytes()


def rarity_of_bins(spark: SparkSession, counted: bytes) -> Column:
    """`rarities` as an array of bytes.

    It is a scalar subquery and not a literal, which the driver would hold as text, a megabyte or more for each time that a plan is told.
    """
    letters = spark.createDataFrame([("".join(chr(c + 1) for c in counted),)], "codes string")
    return written(letters.select(F.transform(F.split("codes", ""), lambda c: (F.ascii(c) - 1).cast("tinyint")).alias("codes")), "rarity").scalar()


def may_have(keys: DataFrame, key: Column, own: Column) -> Column:
    """A predicate on `own`: true for all that some row of keys has as its `key`, and for a few others, by a table of bits.

    The table is a scalar subquery, as that of rarities.
    """
    rest = 64 - BITS
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    bins = keys.select(F.shiftrightunsigned(key, rest - 6).alias("h")).select(F.shiftrightunsigned("h", 6).cast("int").alias("bin"), one.alias("bits"))
    each = bins.unionByName(keys.sparkSession.range(1 << BITS).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("bits")))
    each = each.groupBy("bin").agg(F.bit_or("bits").alias("bits"))  # 2**BITS rows
    bits = written(each.agg(F.sort_array(F.collect_list(F.struct("bin", "bits"))).alias("a")).select(F.col("a.bits").alias("bits")), "bits").scalar()
    return F.call_function("getbit", bits[F.shiftrightunsigned(own, rest).cast("int")], F.shiftrightunsigned(own, rest - 6).bitwiseAND(63).cast("int")) == 1


def can_match(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Of two sets, each given by n, parity and parity_2: the most tokens that may differ, which bound the bits in which their parities differ, and the length filter."""
    n, m = a["n"], b["n"]
    parity, second = a["parity"].bitwiseXOR(b["parity"]), a["parity_2"].bitwiseXOR(b["parity_2"])
    few = lambda bits: bits * (100 + percent) <= (n + m) * (100 - percent)
    # The first is what nearly all pairs fail.
    both = few(F.bit_count(parity)) & ((F.least(n, m) < LONG) | few(F.bit_count(parity.bitwiseXOR(second)) + F.bit_count(second)))
    return both & (n * 100 >= m * percent) & (m * 100 >= n * percent)


def removed_lines(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines that an earlier line of the corpus matches: id, line (from 0), equal.

    Lines are in the order of id and place. Their tokens are the distinct words in lower case; two lines
    match if the Jaccard similarity of their tokens is at least percent / 100. `equal` says that the earlier
    line has the same tokens. A line without words, so every line of a null or empty text, neither matches
    nor is removed; rows with a null id come first. Ids should be unique: the lines at one place of several rows with an id
    are judged as any of them. Other columns are ignored.

    The join is exact, up to hashes: 64 bits of a word's, and 128 of a set's. Lines of equal tokens are one
    class, known by its first line. Tokens are ordered by rarity: how many lines have them, counted in
    2**BINS bins, then by hash. Classes that match share a token of their prefixes, which the sketch must have
    counted twice, and pass the length, positional and parity filters. Pairs that pass are verified on their
    tokens, read again from their first lines; the later of two that match goes.

    The lines of a large group of variants would make pairs with the square of its size. So each line is first
    compared with the first of all lines that share a sign with it: the least and the greatest hash of its prefix,
    and hot tokens. That decides nearly all of such a group, and a line that is decided is
    compared with no earlier one again.
    """
    docs = df.select(F.col(id_col).alias("id"), F.lower(text_or_empty(text_col)).alias("text"))
    split = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    # A filter on the hashes would be pushed below and compute them twice.
    sets = written(split.filter(F.col("text").rlike(r"[^ \t\r]")).select("id", "line", hashes(F.col("text")).alias("hashes")), "sets")
    rarity = rarity_of_bins(df.sparkSession, rarities(sets))

    def key(h: Column) -> Column:
        """The rarity of its bin, above the bits of the hash. Never null, so that arrays are sorted as primitive ones."""
        return F.coalesce(F.shiftleft(F.col("rarity")[bin_of(h)].cast("long"), HASH).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH)), F.lit(0).cast("long"))

    n = F.size("tokens")
    bit = lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int")))
    nothing = F.lit(0).cast("long")
    # Tokens whose seventh bit is set are counted in the second half, which is zero in short lines; the first half is what the parity has beside it.
    second = F.when(n >= LONG, F.aggregate(F.filter("tokens", lambda t: t.bitwiseAND(64) != 0), nothing, bit)).otherwise(nothing)
    once, hot = (F.lit(x << HASH).cast("long") for x in (1, code(HOT)))
    # 31 bits, as an accident makes a candidate and no match, and one that says whether the token is hot; 0 for one that no other line has.
    token = lambda t: F.when(t < once, 0).otherwise(F.hash(t).bitwiseOR(1).bitwiseXOR((t < hot).cast("int")))
    prefix = F.transform(F.slice("tokens", F.lit(1), n - F.ceil(n * F.lit(percent) / F.lit(100)).cast("int") + 1), token)
    names = lambda x: (F.xxhash64(x).alias("class"), F.xxhash64(F.lit(1), x).alias("class_2"))
    # No function of arrays may have a subquery of its own, so this is a column first.
    ordered = sets.withColumn("rarity", rarity).select("id", "line", "hashes", F.sort_array(F.transform("hashes", key)).alias("tokens"))
    lines = written(ordered.select("id", "line", *names("hashes"), n.alias("n"), F.aggregate("tokens", nothing, bit).alias("parity"), second.alias("parity_2"), prefix.alias("prefix")), "lines")
    delete(sets)
    told = [F.col("id").eqNullSafe(F.col("to_id")), F.col("line") == F.col("to_line")]
    place = F.struct(F.col("id").isNotNull().alias("has"), "id", "line")
    of = lambda x: {c: F.col(f"{x}.{c}") for c in ("n", "parity", "parity_2")}

    def matched(pairs: DataFrame, in_turn: bool) -> DataFrame | None:
        """The classes (class, class_2, id, line) of the later lines of pairs (id, line, early) whose tokens match; None without pairs.

        In turn: each is first compared with the earliest of its partners, the others are left for those that it doesn't match.
        """
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            return None
        wanted = written(pairs.select("id", "line").unionByName(pairs.select("early.id", "early.line")).distinct().toDF("to_id", "to_line"), "wanted")
        some = docs.filter(may_have(wanted, F.xxhash64("to_id"), F.xxhash64("id")))
        found = some.select("id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(may_have(wanted, F.xxhash64("to_id", "to_line"), F.xxhash64("id", "line")))
        read = written(found.join(wanted.hint("merge"), told).select("to_id", "to_line", hashes(F.col("text")).alias("hashes")), "read")

        def verified(chosen: DataFrame) -> DataFrame:
            mine = chosen.join(read, told).select("id", "line", "early", F.col("hashes").alias("own"))
            both = mine.join(read, [F.col("early.id").eqNullSafe(F.col("to_id")), F.col("early.line") == F.col("to_line")])
            both = both.filter(F.size(F.array_intersect("own", "hashes")) * (100 + percent) >= (F.size("own") + F.size("hashes")) * percent)
            return both.select(*names("own"), "id", "line").distinct()

        if not in_turn:
            return written(verified(pairs), "sure")
        sure = written(verified(pairs.groupBy("id", "line").agg(F.min("early").alias("early"))), "sure")
        rest = pairs.join(sure.select(F.col("id").alias("to_id"), F.col("line").alias("to_line")), told, "left_anti")
        return sure.unionByName(verified(rest)).distinct()

    early = lambda x: F.struct(F.col(f"{x}.id").isNotNull().alias("has"), F.col(f"{x}.id").alias("id"), F.col(f"{x}.line").alias("line")).alias("early")
    live = F.array_remove("prefix", 0)
    is_hot = lambda t: t.bitwiseAND(1) == 1
    hot_ones = F.when(is_hot(F.element_at("prefix", -1)), F.filter(live, is_hot)).otherwise(F.array().cast("array<int>"))  # the most frequent token of the prefix is its last
    signs = F.array_distinct(F.concat(F.array(F.array_min(live), F.array_max(live)), hot_ones))
    own = ("id", "line", "class", "n", "parity", "parity_2")
    rows = lines.filter(F.size(live) > 0).select(F.explode(signs).alias("sign"), *own).alias("own")
    led = rows.withColumn("lead", F.first(F.struct(*own)).over(W.partitionBy("sign").orderBy("id", "line"))).filter((F.col("class") != F.col("lead.class")) & can_match(of("own"), of("lead"), percent))
    led = led.groupBy("class", early("lead")).agg(F.min(place).alias("place"))  # all lines of a class have its signs, so this is its first
    decided = matched(led.select("place.id", "place.line", "early"), in_turn=False)

    grouped = lines.groupBy("class", "class_2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "parity", "parity_2", "prefix")))
    grouped = grouped.withColumn("gone", F.lit(0)) if decided is None else grouped.join(decided.select("class", "class_2").distinct().withColumn("gone", F.lit(1)), ["class", "class_2"], "left")
    classes = written(grouped.select("class", "class_2", "copies", F.col("first.id").alias("id"), F.col("first.line").alias("line"), "n", "parity", "parity_2", "prefix", F.coalesce("gone", F.lit(0)).alias("gone")), "classes")
    # The size, whether it is decided, and the place in one long, so that rows are narrow.
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("gone").cast("long"), 31)).bitwiseOR(F.col("at").cast("long"))
    rows = classes.select("id", "line", "n", "parity", "parity_2", "gone", F.posexplode("prefix").alias("at", "token")).filter("token <> 0").select("token", "id", "line", "parity", "parity_2", packed.alias("size_at"))
    a, b = rows.alias("a"), rows.alias("b")
    size, at = ({x: f(F.col(f"{x}.size_at")) for x in "ab"} for f in (lambda c: F.shiftright(c, 32), lambda c: c.bitwiseAND((1 << 31) - 1)))
    before = (F.col("a.id") < F.col("b.id")) | (F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.line") < F.col("b.line"))) | (F.col("a.id").isNull() & F.col("b.id").isNotNull())
    positional = F.least(size["a"] - at["a"], size["b"] - at["b"]) * (100 + percent) >= (size["a"] + size["b"]) * percent
    undecided = F.shiftright(F.col("b.size_at"), 31).bitwiseAND(1) <= F.col("a.size_at").bitwiseAND(0)
    # All conditions are of both sides (`undecided` for that reason alone), so that both read one exchange, whose large partitions may be split.
    fits = can_match(*(of(x) | {"n": size[x]} for x in "ab"), percent) & undecided & positional & before
    found = matched(a.join(b, (F.col("a.token") == F.col("b.token")) & fits).select(F.col("b.id").alias("id"), F.col("b.line").alias("line"), early("a")).distinct(), in_turn=True)
    firsts = classes.filter("copies > 1").select("class", "class_2", "id", "line", F.lit(False).alias("similar"))
    for gone in (decided, found):
        firsts = firsts if gone is None else firsts.unionByName(gone.withColumn("similar", F.lit(True)))
    firsts = firsts.groupBy("class", "class_2").agg(F.first("id").alias("first_id"), F.first("line").alias("first_line"), F.bool_or("similar").alias("similar"))
    # As a table the next join can be split at a class of many copies.
    firsts = written(firsts, "told")
    each = lines.select("class", "class_2", "id", "line").join(firsts, ["class", "class_2"]).withColumn("equal", ~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line"))))
    return each.filter("equal OR similar").select(F.col("id").alias(id_col), "line", "equal")


def without_lines(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, with all its columns, its texts without the lines of `removed_lines`. A document whose lines all go keeps an empty text."""
    key, lines = fresh(df, "id", "gone")
    gone = removed_lines(df, percent, id_col, text_col).groupBy(F.col(id_col).alias(key)).agg(F.collect_list("line").alias(lines))  # at most a document's lines
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(F.col(lines), i)), "\n")
    return df.join(gone, F.col(id_col).eqNullSafe(F.col(key)), "left").withColumn(text_col, F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(kept)).select(*df.columns)
