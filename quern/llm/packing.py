"""Best-fit packing of token sequences with a swap-based local search (operator 1)."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_batch, text_or_empty, written

#: Pieces that one task packs together.
BLOCK = 20_000
#: The vocabulary's string that stands for a token of its own.
SPECIAL = "<|endoftext|>"
#: Runs of what \s is in the vocabulary's pattern (Python's own has \x1c-\x1f besides), that tiktoken's pattern is not given: it backtracks over them, and raises from some 800,000 on.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")


@cache
def encoder(ranks: str, special: int):
    """The byte-level BPE of a .tiktoken file: the same ids as its .json by the tokenizers library, some five times as fast."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={SPECIAL: special})


def token_ids(encode, text: str) -> np.ndarray:
    """The ids of a text of any length. Where tiktoken raises, long white space is cut out as the pattern cuts it: all of a run but its last character is a chunk, and at the end of the text or before SPECIAL all of it."""
    try:
        return encode.encode_to_numpy(text, allowed_special={SPECIAL})
    except ValueError:
        if not LONG_SPACE.search(text):
            raise
    parts = []
    for k, segment in enumerate(text.split(SPECIAL)):
        if k:
            parts.append(encode.encode_to_numpy(SPECIAL, allowed_special={SPECIAL}))
        at = 0
        for m in LONG_SPACE.finditer(segment):
            end = m.end() - (m.end() < len(segment))
            parts.append(encode.encode_to_numpy(segment[at : m.start()], disallowed_special=()))
            parts.append(np.array(encode._encode_single_piece(segment[m.start() : end]), dtype="u4"))
            at = end
        parts.append(encode.encode_to_numpy(segment[at:], disallowed_special=()))
    return np.concatenate(parts)


def token_pieces(df: DataFrame, ranks: str, capacity: int = 2048, end: int = 0, special: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token sequence of each text, with `end` after it, in pieces of at most `capacity`.

    One row a piece: id, piece (from 0), start, length, ids_crc32 (of the ids as little-endian unsigned
    32-bit numbers). Only a longer sequence is cut; its first piece takes what is left over. A null text
    is an empty one, whose only piece is the end token. Rows with the same id each give their pieces.
    """

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        encode = encoder(ranks, special)
        out: dict[str, list] = {k: [] for k in (id_col, "piece", "start", "length", "ids_crc32")}
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(token_ids(encode, text), end).astype("<u4")
            at, piece = 0, 0
            size = len(ids) % capacity or capacity
            while at < len(ids):
                out[id_col].append(key)
                out["piece"].append(piece)
                out["start"].append(at)
                out["length"].append(size)
                out["ids_crc32"].append(zlib.crc32(ids[at : at + size].tobytes()))
                at, piece, size = at + size, piece + 1, capacity
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return by_batch(df.select(id_col, text_or_empty(text_col).alias("text")), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long", run)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of positions in `lengths`. A bit set of the free spaces in use finds the tightest bin in a step."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        above = used >> n
        if above:
            space = n + (above & -above).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                used ^= 1 << space
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if space > n:
            free[space - n].append(b)
            used |= 1 << (space - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, passes: int = 8, tries: int = 32) -> list[list[int]]:
    """Exchanges between underfull bins that increase the sum of squared fills, until bins are empty or no exchange is left.

    Each fuller bin in turn is filled from the emptiest ones: by a move, by one document for one longer,
    one for two, or two for one. Taking d more tokens into a bin of fill a from one of fill b changes the
    sum by 2d(a - b + d), so it is done only for a + d > b. `passes` bounds how often all bins are tried,
    and `tries` with how many of the emptiest bins each is compared.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    for _ in range(passes):
        open_bins = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        if len(open_bins) < 2:
            break
        changed = False
        for k in range(len(open_bins) - 1, 0, -1):
            a = open_bins[k]
            for b in open_bins[: min(k, tries)]:
                if fill[a] == capacity or fill[a] == 0:
                    break
                while fill[b] and (step := exchange(bins[a], bins[b], lengths, capacity - fill[a], fill[a] - fill[b])):
                    out, came = step
                    for i in out:
                        bins[a].remove(i)
                        bins[b].append(i)
                    for i in came:
                        bins[b].remove(i)
                        bins[a].append(i)
                    d = sum(lengths[i] for i in came) - sum(lengths[i] for i in out)
                    fill[a], fill[b], changed = fill[a] + d, fill[b] - d, True
        if not changed:
            break
    return [b for b in bins if b]


def exchange(a: list[int], b: list[int], lengths: list[int], gap: int, lead: int) -> tuple[list[int], list[int]] | None:
    """The exchange (out of a, into a) that fills a's gap best: d tokens more with -lead < d <= gap, d > 0."""
    best, found = max(0, -lead), None
    mine = ends(sorted((lengths[i], i) for i in a))
    yours = ends(sorted((lengths[i], i) for i in b))

    def tightest(items: list[tuple[int, int]], most: int, skip: int = -1) -> tuple[int, int] | None:
        k = bisect_left(items, (most + 1, -1)) - 1
        while k >= 0 and items[k][1] == skip:
            k -= 1
        return items[k] if k >= 0 else None

    def offer(d: int, out: list[int], came: list[int]) -> None:
        nonlocal best, found
        if best < d <= gap:
            best, found = d, (out, came)

    if y := tightest(yours, gap):
        offer(y[0], [], [y[1]])
    for n, i in mine:
        if best == gap:
            return found
        if y := tightest(yours, gap + n):
            offer(y[0] - n, [i], [y[1]])
    for m, j in yours:
        if best == gap:
            return found
        for n, i in mine:
            if m > gap + n:
                continue
            if y := tightest(yours, gap + n - m, j):  # two of b's for one of mine
                offer(y[0] + m - n, [i], [j, y[1]])
        for n, i in mine:
            if n < m and (x := least(mine, m - n - gap, i)):  # one of b's for two of mine
                offer(m - n - x[0], [i, x[1]], [j])
    return found


def ends(items: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The first and the last item of each length: no exchange takes more than two of one length. So a bin of many short pieces has few items, some 126 at a capacity of 2048."""
    return [x for k, x in enumerate(items) if not 0 < k < len(items) - 1 or not items[k - 1][0] == x[0] == items[k + 1][0]]


def least(items: list[tuple[int, int]], bound: int, skip: int) -> tuple[int, int] | None:
    k = bisect_left(items, (bound, -1))
    while k < len(items) and items[k][1] == skip:
        k += 1
    return items[k] if k < len(items) else None


def pack_block(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def settler(names: list[str], capacity: int, last: bool, level: int):
    """Packs the pieces of a block; all but the emptiest bins, or in the last block all, are settled."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row", ignore_index=True)
        lengths = group["length"].tolist()
        bins = sorted(pack_block(lengths, capacity), key=lambda b: sum(lengths[i] for i in b))
        reopened = 0 if last else max(2, len(bins) // 16)
        first = (level << 56) | (int(group["_block"][0]) << 24)
        sequence, offset, settled = (np.zeros(len(lengths), dtype=t) for t in ("int64", "int64", "bool"))
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = first | k, at
                at += lengths[i]
            settled[b] = k >= reopened or at == capacity
        return group[names].assign(sequence_id=sequence, offset=offset, settled=settled)

    return settle


def pack(pieces: DataFrame, capacity: int = 2048, block: int = BLOCK) -> DataFrame:
    """Packs pieces (columns of `token_pieces`) into sequences: adds sequence_id and offset.

    A full piece is a sequence by itself (with a negative number). The others are dealt at random to
    blocks of some `block` pieces, each packed by one task: best-fit decreasing, then the local search.
    The emptiest sixteenth of a block's bins, as far as they are underfull, is opened again and dealt to
    fewer blocks, until one block is left; so what is lost is one bin's rest in all. Repeated pieces are
    pieces of their own, whatever their id, so no id or length makes a block larger than others.
    An empty input gives an empty result. Other columns of `pieces` are kept.
    """
    names = [*pieces.columns]
    rows = pieces.withColumn("_row", F.monotonically_increasing_id())
    full = rows.filter(F.col("length") >= capacity).select(*names, (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = [full]
    left = rows.filter(F.col("length") < capacity)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, settled boolean"
    level = 0
    while True:
        n = left.count()
        blocks = max(1, -(-n // block))
        dealt = left.withColumn("_block", F.pmod(F.xxhash64(F.col("_row"), F.lit(level)), F.lit(blocks)))

        packed = written(dealt.groupBy("_block").applyInPandas(settler(names, capacity, blocks == 1, level), schema), f"packed-{level}")
        parts.append(packed.filter("settled").drop("settled"))
        if blocks == 1:
            break
        left = packed.filter("NOT settled").select(*names).withColumn("_row", F.monotonically_increasing_id())
        level += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(df: DataFrame, ranks: str, capacity: int = 2048, end: int = 0, special: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`token_pieces`, written once, and `pack`."""
    return pack(written(token_pieces(df, ranks, capacity, end, special, id_col, text_col), "pieces"), capacity)
