"""Exact Jaccard join of word n-gram sets over a prefix tree (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import by_batch, fresh, partitions, text_or_empty, written
from quern.llm.graph import components
from quern.llm.packed import packed_keys, packed_owners, ranges, runs, unpacked_keys, unpacked_owners

#: Documents and n-grams of a block that one task compares.
DOCS, GRAMS = 1_500, 1_500_000
#: Documents of a group of linked ones that are compared with other groups at first.
REPRESENTATIVES = 16
#: Documents whose keys a task holds at once, and bytes of text for each range of keys.
AT_ONCE = 2_500
PART = 32 << 20
#: Words whose hash a worker remembers.
KEPT = 100_000
U64 = np.uint64
FACTORS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
S29, S32, S33 = U64(29), U64(32), U64(33)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S33)) * FACTORS[0]
    h = (h ^ (h >> S29)) * FACTORS[1]
    return h ^ (h >> S32)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


@cache
def hashes() -> Hashes:
    return Hashes()


def grams(text: str, n: int = 4) -> np.ndarray:
    """The distinct n-grams of a text's words (A-Z lower-cased) as ascending 64-bit hashes, which is their global order; with fewer words the whole sequence is one."""
    words = text.encode().lower().split()
    h = np.fromiter(map(hashes().__getitem__, words), U64, len(words))
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, U64)
    for i in range(k):
        out = mix(out * FACTORS[2] + h[i : len(h) - k + 1 + i])
    return np.unique(out)


class Classes:
    """Classes of sizes: partners whose Jaccard similarity can reach `percent` are in the same class or adjacent ones."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            b = self.starts[-1]
            self.starts.append(max(b + 1, (b - 1) * 100 // self.percent + 1))
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def span(self, c: int) -> tuple[int, int]:
        while len(self.starts) <= c + 1:
            self.of(self.starts[-1])
        return self.starts[c], self.starts[c + 1] - 1

    def different(self, c: int) -> int:
        """The most n-grams in which a linked pair differs whose larger set is in class c."""
        return 2 * self.span(c)[1] * (100 - self.percent) // (100 + self.percent)


@cache
def classes(percent: int) -> Classes:
    return Classes(percent)


def keys(h: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set of which two linked sets that aren't equal share one at least.

    The hashes' range is cut into K segments, and the key is what is in a segment. If at most D n-grams
    differ, at most D segments do, so of more than D segments that aren't empty one is equal. A set with so
    few (K is D + 1 and some more, at some six n-grams for each) also has the keys of empty ones. K and D
    are those of a class of sizes; a set has keys in its own, and in the next as the smaller partner.
    """
    known, out = classes(percent), []
    c = known.of(len(h))
    for k in (c, c + 1):
        low, _ = known.span(k)
        d = known.different(k)
        if d == 0 or low * percent > len(h) * 100:
            continue
        segments = d + 3 + d // 10
        at = ((h >> S32) * U64(segments)) >> S32
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        salt = U64(k) << S32
        out.append(mix(np.add.reduceat(h, first) ^ mix(salt + at[first] + U64(1))))
        if len(first) <= d:
            empty = np.setdiff1d(np.arange(segments, dtype=U64), at[first])
            out.append(mix(mix(salt + empty + U64(1)) + U64(7)))
    return np.concatenate(out) if out else np.zeros(0, U64)


def digest(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def parity(h: np.ndarray) -> bytes:
    """Of each value of the hashes' low bits whether an odd number of them has it: a power of two of bits, about as many as there are n-grams."""
    b = 64
    while 4 * b < 3 * len(h):
        b *= 2
    return np.packbits((np.bincount((h & U64(b - 1)).astype(np.int64), minlength=b) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A parity as it is with fewer low bits, 64 for each word."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def sets(df: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Of each document the size of its set, a 128-bit digest of it as two numbers, and its `parity`."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"id": batch.column(0), "n_shingles": [], "a": [], "b": [], "bits": []}
        for text in batch.column(1).to_pylist():
            h = grams(text, n)
            a, b = digest(h)
            out["n_shingles"].append(len(h))
            out["a"].append(a)
            out["b"].append(b)
            out["bits"].append(parity(h))
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return by_batch(df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), f"id {kind}, n_shingles long, a long, b long, bits binary", run)


def candidate_edges(df: DataFrame, n: int, percent: int, text_col: str) -> DataFrame:
    """Edges (u, v) between the digests of sets that share a key, a star for each key.

    Keys are dealt by ranges of their hash. Equal sets of some AT_ONCE texts count once, and of these sets with
    the same key only the first goes on with it, so a key of many documents reaches its task once for
    each such lot, and the others are linked to that first at once. Keys go as packed arrays, not as rows.
    """
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(2 * partitions(df.sparkSession), -(-size // PART))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            found, owners, seen = [], [], set()
            for text in batch.column(0).to_pylist():
                h = grams(text, n)
                a, b = digest(h) if len(h) else (0, 0)
                if not len(h) or (a, b) in seen:
                    continue
                seen.add((a, b))
                found.append(keys(h, percent))
                owners.append(np.full(len(found[-1]), a))
            if not found:
                continue
            key, owner = np.concatenate(found), np.concatenate(owners)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            leader = owner[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            edges = np.unique(np.stack([leader[~new], owner[~new]], axis=1), axis=0)
            key, owner = key[new], owner[new]
            some, cut = ranges(key, parts)
            linked = [edges[:, 0].astype("<i8").tobytes()] if len(edges) else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*some, *([int(edges[0, 0] % parts)] if linked else [])], pa.int32()),
                    pa.array([False] * len(some) + [True] * len(linked)),
                    pa.array([*(packed_keys(key[c]) for c in cut), *linked], pa.binary()),
                    pa.array([*(packed_owners(owner[c]) for c in cut), *([edges[:, 1].astype("<i8").tobytes()] if linked else [])], pa.binary()),
                ],
                names=["range", "is_edges", "keys", "owners"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, is_edges), rows in runs(batches, 2):
            both = [(k, o) for _, _, k, o in rows]
            if is_edges:
                edges = np.concatenate([np.stack([np.frombuffer(k, "<i8"), np.frombuffer(o, "<i8")], axis=1) for k, o in both])
            else:
                key, owner = np.concatenate([unpacked_keys(k) for k, _ in both]), np.concatenate([unpacked_owners(o) for _, o in both])
                del both
                order = np.argsort(key, kind="stable")
                key, owner = key[order], owner[order]
                new = np.concatenate([[True], key[1:] != key[:-1]])
                leader = owner[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
                differ = leader != owner
                edges = np.stack([leader[differ], owner[differ]], axis=1)
            edges = np.unique(edges, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    rows = df.select(text_or_empty(text_col).alias("text")).mapInArrow(split, "range int, is_edges boolean, keys binary, owners binary")
    return rows.repartition(parts, "range").sortWithinPartitions("range", "is_edges").mapInArrow(meet, "u long, v long")


class Node:
    __slots__ = ("tokens", "children", "docs", "rest", "least", "most", "low", "high", "last", "one")

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.children, self.docs = tokens, [], []


def tree(ordered: list[np.ndarray], sizes: np.ndarray) -> tuple[Node, list[int]]:
    """The prefix tree of the sets, whose paths without branches are one node, and the sets in its order.

    Each node knows of what is below it: the smallest and largest set, the most n-grams to come and the
    first and last place in the tree's order.
    """
    order = sorted(range(len(ordered)), key=lambda i: ordered[i].astype(">u4").tobytes())
    root = Node(np.zeros(0, np.int64))
    path: list[tuple[Node, int]] = [(root, 0)]  # nodes and the depth at their end
    before = np.zeros(0, np.int64)
    for place, i in enumerate(order):
        own = ordered[i]
        k = min(len(before), len(own))
        differ = np.flatnonzero(before[:k] != own[:k])
        shared = int(differ[0]) if len(differ) else k
        while path[-1][1] > shared:
            node, end = path.pop()
            above = path[-1][1]
            if above < shared:  # split the node
                head = Node(node.tokens[: shared - above])
                node.tokens = node.tokens[shared - above :]
                path[-1][0].children[-1] = head
                head.children.append(node)
                path.append((head, shared))
        if len(own) > shared:
            node = Node(own[shared:])
            path[-1][0].children.append(node)
            path.append((node, len(own)))
        path[-1][0].docs.append(place)
        before = own
    walk = [root]
    for node in walk:
        walk.extend(node.children)
    for node in reversed(walk):
        below = node.children
        own = [int(sizes[order[p]]) for p in node.docs]
        node.rest = max([0, *(len(c.tokens) + c.rest for c in below)])
        node.least = min([*own, *(c.least for c in below)], default=0)
        node.most = max([*own, *(c.most for c in below)], default=0)
        node.low = min([*node.docs, *(c.low for c in below)], default=0)
        node.high = max([*node.docs, *(c.high for c in below)], default=0)
        node.one = False
        node.last = int(node.tokens[-1]) if len(node.tokens) else -1
    return root, order


def links(found: list[np.ndarray], sizes: np.ndarray, sides: np.ndarray | None, percent: int, known: list | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets whose Jaccard similarity is at least percent / 100, as many as join all that are linked.

    All pairs, or with sides those between sides 0 and 1. N-grams that are in one set only link nothing and
    count in its size alone; the others are ordered by falling frequency, so that sets share long paths of
    the tree. Each set traverses it with the overlap so far. It leaves out what is below a node if the
    sizes there can't fit, or the overlap, with all that can still come on both sides, doesn't suffice.
    A pair that is already joined through others isn't looked at again, nor is what is below a node once all
    of it is joined with the set, so a family of n copies takes some n steps and not n * n / 2. The last place
    before its own is looked at first, where the sets are most alike. known: sets with the same label are joined from the start.
    """
    every = np.concatenate(found)
    _, at, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    ends = np.cumsum([len(x) for x in found])[:-1]
    ordered = [np.sort(rank[x[count[x] > 1]]) for x in np.split(at, ends)]
    root, order = tree(ordered, sizes)
    size = [int(sizes[i]) for i in order]
    side = None if sides is None else [int(sides[i]) for i in order]
    mark = np.zeros(len(count), np.int64)
    up = list(range(len(order)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    if known is not None:
        heads: dict = {}
        for x, i in enumerate(order):
            up[x] = heads.setdefault(known[i], x)

    def joined(node: Node, x: int) -> bool:
        """Whether all below the node is joined with x."""
        if not node.one:
            if not all(c.one for c in node.children):
                return False
            under = [*node.docs, *(c.low for c in node.children)]
            if any(top(y) != top(under[0]) for y in under):
                return False
            node.one = True
        return top(node.low) == top(x)

    out = []
    for x in range(len(order)):
        own = ordered[order[x]]
        n = size[x]
        low, high = -(-n * percent // 100), n * 100 // percent
        mark[own] = 1
        stack = [(child, 0) for child in root.children if child.low < x]
        while stack:
            node, overlap = stack.pop()
            if node.most < low or node.least > high or node.high < x and joined(node, x):
                continue
            got = overlap + int(mark[node.tokens].sum())
            left = min(len(own) - int(np.searchsorted(own, node.last, "right")), node.rest)
            if (got + left) * (100 + percent) < percent * (n + max(low, node.least)):
                continue
            for y in node.docs:
                if y < x and (side is None or side[x] != side[y]) and got * (100 + percent) >= percent * (n + size[y]) and (a := top(x)) != (b := top(y)):
                    up[max(a, b)] = min(a, b)
                    out.append((order[x], order[y]))
            stack += [(child, got) for child in node.children if child.low < x]
        mark[own] = 0
    return out


def with_level(members: DataFrame, percent: int) -> DataFrame:
    """Adds `level`, the class of n_shingles."""
    known, names, sizes = classes(percent), members.columns, members.columns.index("n_shingles")

    def level(batch: pa.RecordBatch) -> dict[str, list]:
        return dict(zip(names, batch.columns, strict=True)) | {"level": [known.of(n) for n in batch.column(sizes).to_pylist()]}

    return by_batch(members, ", ".join(f"{c} {kind}" for c, kind in [*members.dtypes, ("level", "int")]), level)


def cell_count(docs: str, total: str) -> Column:
    """Into how many parts documents are cut, so that each fits into a task."""
    return F.greatest(F.ceil(F.col(docs) / F.lit(DOCS)), F.ceil(F.col(total) / F.lit(GRAMS))).cast("int")


def blocks(members: DataFrame, percent: int) -> DataFrame:
    """Deals candidates (id, component, n_shingles, sure) to blocks: (id, component, sure, block (string), side).

    A component of candidates that fits into a task is a block. A larger one is cut by class of sizes and
    hash into cells; each pair of its cells of the same or of adjacent classes is a block, so any two sets
    that can be linked meet in one.
    """
    leveled = with_level(members.select("id", "component", "n_shingles", "sure"), percent)
    cells = leveled.groupBy("component", "level").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("total"))
    parts = cell_count("docs", "total")
    sums = cells.groupBy("component").agg(F.sum("docs").alias("all_docs"), F.sum("total").alias("all_total"), F.map_from_arrays(F.collect_list("level"), F.collect_list(parts)).alias("parts"))
    sums = written(sums, "sums")  # as a table of its own the join can be split at a large component
    small = (F.col("all_docs") <= DOCS) & (F.col("all_total") <= GRAMS)
    told = leveled.join(sums, "component").withColumn("cell", F.pmod(F.xxhash64("id"), F.element_at("parts", F.col("level"))).cast("int"))

    def pairs(shift: int):
        """This cell with those of the class `shift` above its own."""
        other = F.coalesce(F.try_element_at("parts", F.col("level") + shift), F.lit(0))
        name = lambda i: F.concat_ws("/", F.lit("cells"), F.col("level") + F.lit(min(0, shift)), *( [F.least("cell", i), F.greatest("cell", i)] if shift == 0 else [F.lit("up"), *( ["cell", i] if shift > 0 else [i, "cell"])]))
        side = lambda i: F.when(F.lit(shift == 0), F.when(i == F.col("cell"), -1).when(F.col("cell") < i, 0).otherwise(1)).otherwise(F.lit(0 if shift > 0 else 1))
        return F.transform(F.when(other > 0, F.sequence(F.lit(0), other - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(name(i).alias("block"), side(i).cast("int").alias("side")))

    whole = F.array(F.struct(F.lit("all").alias("block"), F.lit(-1).alias("side")))
    return told.withColumn("at", F.explode(F.when(small, whole).otherwise(F.concat(pairs(0), pairs(1), pairs(-1))))).select("id", "component", "sure", F.col("at.block").alias("block"), F.col("at.side").alias("side"))


def surely_linked(some: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component) of documents of large components that are found linked at a cost in proportion to their number.

    Each document is compared with those of its own cell, then with others of the component some REPRESENTATIVES of each
    group that this finds. Most of a large family of near copies is one group then; what isn't stays to
    be compared exactly.
    """
    leveled = with_level(some.select("id", "component", "n_shingles"), percent)
    cells = leveled.groupBy("component", "level").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("total"))
    cells = written(cells.select("component", "level", cell_count("docs", "total").alias("parts")), "cells")
    alone = lambda block: (F.col("id").alias("sure"), block.alias("block"), F.lit(-1).alias("side"))
    dealt = leveled.join(cells, ["component", "level"]).select("id", "component", *alone(F.concat_ws("/", F.lit("cell"), "level", F.pmod(F.xxhash64("id"), "parts"))))
    first = written(components(verify(docs.join(dealt.hint("merge"), "id"), n, percent)).select(F.col("node").alias("id"), F.col("component").alias("sure")), "first")
    few = F.row_number().over(W.partitionBy("sure").orderBy(F.xxhash64("id"), "id")) <= REPRESENTATIVES  # a group is within a cell
    chosen = written(first.withColumn("few", few).filter("few").select("id").join(some.select("id", "component", "n_shingles"), "id"), "chosen")
    sums = written(chosen.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("total")).select("component", cell_count("docs", "total").alias("parts")), "chosen-sums")
    dealt = chosen.join(sums, "component").select("id", "component", *alone(F.concat_ws("/", F.lit("chosen"), F.pmod(F.xxhash64("id"), "parts"))))
    second = verify(docs.join(dealt.hint("merge"), "id"), n, percent)
    return components(first.select(F.col("sure").alias("u"), F.col("id").alias("v")).unionByName(second))


def refined(members: DataFrame, docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """members (id, component, n_shingles, bits) as (id, component, n_shingles, sure), and links already known (node, component) if any; large components of candidates are taken apart, as far as that loses no link.

    Documents of the same `sure` are linked already (`surely_linked`) and aren't compared again. Documents
    that share common passages can make a large component by accident. Its cells meet here with
    their parities alone: two sets that differ in d n-grams have parities that differ in d bits at most. A
    document that passes with none of another group needs no comparison; groups connected by pairs that pass are a component of their own.
    """
    sums = written(members.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("total")), "large")
    large = (F.col("docs") > DOCS) | (F.col("total") > GRAMS)
    told = members.join(sums, "component")
    columns = ["id", "component", "n_shingles", "sure"]
    whole = told.filter(~large).withColumn("sure", F.col("id")).select(*columns)
    some = written(told.filter(large).select(*members.columns), "some")
    if some.isEmpty():
        return whole, None
    sure = written(surely_linked(some, docs, n, percent), "sure")
    labels = sure.select(F.col("node").alias("id"), F.col("component").alias("_sure"))
    some = written(some.join(labels, "id", "left").select(*members.columns, F.coalesce("_sure", "id").alias("sure")), "grouped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, block), rows in runs(batches, 2):
            _, _, side, ids, group, size, bits = zip(*rows, strict=True)
            own = [np.frombuffer(b, U64) for b in bits]
            n, side = np.array(size), np.array(side)
            names: dict = {}
            known = np.array([names.setdefault(g, len(names)) for g in group])
            if len(names) == 1:
                continue
            widths = sorted({len(b) for b in own})
            at = {w: np.array([i for i, b in enumerate(own) if len(b) == w]) for w in widths}
            stacked = {w: np.stack([own[i] for i in at[w]]) for w in widths}
            label = known.copy()
            told = np.zeros(len(ids), bool)
            out: tuple[list, list, list] = ([], [], [])
            for i, b in enumerate(own):
                for w in widths:
                    if w > len(b):
                        break
                    j = at[w]  # of two widths the wider one is folded and looks for the narrower
                    pick = (n[j] * 100 >= n[i] * percent) & (n[i] * 100 >= n[j] * percent) & (known[j] != known[i])
                    if told[i]:
                        pick &= (label[j] != label[i]) | ~told[j]
                    if w == len(b):
                        pick &= j < i
                    if side.max() >= 0:
                        pick &= side[j] != side[i]
                    if not pick.any():
                        continue
                    j = j[pick]
                    apart = np.bitwise_count(stacked[w][pick] ^ folded(b, w)).sum(axis=1)
                    j = j[apart <= (n[i] + n[j]) * (100 - percent) // (100 + percent)]
                    for k in j:
                        if label[k] != label[i] or not told[i] or not told[k]:
                            for x, y in ((i, k), (k, i)):
                                out[0].append(ids[x])
                                out[1].append(group[x])
                                out[2].append(group[y])
                            told[i] = told[k] = True
                            label[label == label[k]] = label[i]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in out], names=["id", "u", "v"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(members.schema["id"].dataType), members.schema["id"].dataType.simpleString()
    dealt = blocks(some, percent).join(some.select("id", "n_shingles", "bits").hint("merge"), "id").select("component", "block", "side", "id", "sure", "n_shingles", "bits")
    sorted_rows = dealt.repartition(partitions(members.sparkSession), "component", "block").sortWithinPartitions("component", "block")
    passed = written(sorted_rows.mapInArrow(run, f"id {name}, u {name}, v {name}"), "passed")
    found = components(passed.select("u", "v"))
    ends = some.join(passed.select("id").distinct(), "id")
    apart = ends.join(found.select(F.col("node").alias("sure"), F.col("component").alias("_to")), "sure").withColumn("component", F.xxhash64("component", "_to"))
    return whole.unionByName(apart.select(*columns)), sure


def verify(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) of rows (id, component, block, side, sure, text), as many as connect what is linked beside documents of the same `sure`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, found, sides, sure = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                got = links(found, np.array([len(x) for x in found]), np.array(sides) if key[1] != "all" and max(sides) >= 0 else None, percent, sure)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in got], kind), pa.array([ids[j] for _, j in got], kind)], names=["u", "v"])

        for batch in batches:
            for i, component, block, side, group, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (component, block) != key:
                    yield from done()
                    key, ids, found, sides, sure = (component, block), [], [], [], []
                ids.append(i)
                sides.append(side)
                sure.append(group)
                found.append(grams(text, n))
        yield from done()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["id"].dataType)
    name = rows.schema["id"].dataType.simpleString()
    dealt = rows.select("id", "component", "block", "side", "sure", "text").repartition(partitions(rows.sparkSession), "component", "block").sortWithinPartitions("component", "block")
    return dealt.mapInArrow(run, f"u {name}, v {name}")


def jaccard_components(df: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_shingles, component_id: the smallest id reachable by links, its own included.

    Sets of word n-grams link when 100 * intersection >= percent * union; the join is exact (up to 64-bit
    hashes of n-grams). A text without words, or null, has an empty set and links with nothing. Equal sets
    are one class, compared once. Candidates are the classes that share a segment of their ordered sets
    (`keys`); their texts, and only those, go to blocks of connected candidates, where a prefix tree joins
    them (`links`). Ids should be unique; a null id is smallest only among nulls.
    """
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    known = written(sets(df, n, id_col, text_col), "sets")
    full = known.filter("n_shingles > 0")
    near = components(candidate_edges(docs, n, percent, "text"))
    equal = full.groupBy("a", "b").agg(F.min("id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    members = written(equal.join(near.withColumnRenamed("node", "a"), "a").filter("first IS NOT NULL").select(F.col("first").alias("id"), "component", "n_shingles", "bits"), "members")
    # The texts of all documents are shuffled once; what follows reads those of the candidates alone.
    docs = written(docs.join(members.select("id").hint("merge"), "id", "left_semi"), "texts")
    members, sure = refined(members, docs, n, percent)
    members = written(members, "refined")
    # Sort-merge at every size: a broadcast would be chosen for small inputs only, and members grow with the input.
    texts = docs.join(blocks(members, percent).hint("merge"), "id")
    found = verify(texts, n, percent)
    linked = components(found if sure is None else found.unionByName(sure.select(F.col("component").alias("u"), F.col("node").alias("v"))))
    joined = written(equal.join(linked.withColumnRenamed("node", "first"), "first", "left").select("a", "b", F.coalesce("component", "first").alias("component_id")), "joined")  # so that the next join can be split at a class of many copies
    sure = full.join(joined, ["a", "b"]).select(F.col("id").alias(id_col), "n_shingles", "component_id")
    return sure.unionByName(known.filter("n_shingles = 0").select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id")))


def drop_near_copies(df: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whatever their names, that are the smallest id of their component. Rows that share an id are kept or dropped together."""
    (key,) = fresh(df, "kept_id")
    kept = jaccard_components(df, n, percent, id_col, text_col).filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(key)).distinct()
    return df.join(kept, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
