"""SentencePiece BPE by its chunks (operator 5) and token counts by its whole tokens (operator 6).

The model's pieces hold the marker of white space at their start only, so no merge crosses from a
character to a marker. A text is therefore cut into chunks, a run of markers with the characters
after it, and each chunk is segmented by itself. `Chunks` proves that of the model given.

A null text is an empty one: no ids. Every row of the input, repeated ones too, gives one row; columns
other than the id and the text are ignored. Tokens are kept in a table of bounded size in each Python
worker; chunks of more than `LONG` characters are segmented each time. A text of any length is one
row of one batch and never leaves its task: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_batch, text_or_empty

MARK = "▁"
#: Chunks kept by a worker, and characters of the longest.
KEPT, LONG = 300_000, 64
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Chunks:
    """Segments chunks of a SentencePiece BPE model."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses from a character to a marker of white space, so chunks depend on each other")
        if self.model.encode(" a  b ", out_type=str)[:1] == ["a"] or self.model.decode(self.model.encode("  a  b ")) != "  a  b ":
            raise ValueError("the model's normaliser changes white space, so chunks can't be cut from the text")
        self.normal = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.anchor = self.model.piece_to_id("a")

    def ids(self, chunk: str) -> list[int]:
        """chunk: begins with a marker, which the library adds itself."""
        return self.model.encode(chunk[1:].replace(MARK, " ")) if chunk != MARK else [self.model.piece_to_id(MARK)]

    def text(self, ids: list[int]) -> str:
        """What decode() makes of the ids inside a text, where a marker is a space."""
        return self.model.decode([self.anchor, *ids])[1:]

    def whole(self) -> list[str]:
        """The vocabulary's strings that begin with a marker and are encoded alone as one token."""
        return [p for p in self.normal if p[0] == MARK and len(self.ids(p)) == 1]


@cache
def chunks(model: str) -> Chunks:
    return Chunks(model)


def cut(text: str) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class Table(dict):
    """What is made of each distinct chunk, once; bounded."""

    def __init__(self, make, start: dict):
        super().__init__(start)
        self.make, self.start = make, start

    def __missing__(self, chunk: str):
        made = self.make(chunk)
        if len(chunk) <= LONG:
            self[chunk] = made
        return made

    def trim(self) -> None:
        if len(self) > KEPT + len(self.start):
            self.clear()
            self.update(self.start)


@cache
def encoded_chunks(model: str) -> Table:
    own = chunks(model)

    def make(chunk: str) -> tuple[bytes, str]:
        ids = own.ids(chunk)
        return ",".join(map(str, ids)).encode(), own.text(ids)

    return Table(make, {})


@cache
def counted_chunks(model: str) -> Table:
    own = chunks(model)
    return Table(lambda chunk: len(own.ids(chunk)), dict.fromkeys(own.whole(), 1))


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", values: bool = True) -> DataFrame:
    """Encodes and decodes every text: id, n_tokens, digests of both, and with `values` the ids and the decoded text themselves.

    The result is exactly that of the library's encode() and decode() without begin and end ids. Each
    distinct chunk of a worker is segmented once and its ids are put back by position. A table over the
    whole corpus would send every chunk of every text to it and back, several times the size of the
    texts; one for each worker sends nothing. An empty or null text has no ids and the decoded text "".
    """
    extra = ", ids array<int>, decoded string" if values else ""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        known = encoded_chunks(model)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for text in batch.column(1).to_pylist():
            known.trim()
            parts = [known[x] for x in cut(text)]
            ids = b",".join([a for a, _ in parts])
            decoded = "".join([b for _, b in parts])
            decoded = decoded[1:] if decoded[:1] == " " else decoded
            out["n_tokens"].append(ids.count(b",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if values:
                out["ids"].append([int(x) for x in ids.split(b",")] if ids else [])
                out["decoded"].append(decoded)
        return out | {id_col: batch.column(0)}

    kind = df.schema[id_col].dataType.simpleString()
    return by_batch(df.select(id_col, text_or_empty(text_col).alias("text")), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}", run)


def count_tokens(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Tokens of every text: id, n_bytes, n_tokens and whether they exceed `limit`.

    Chunks that are whole tokens, proven from the vocabulary alone, count 1 without being segmented;
    only the rest are merged, each distinct one once in a worker. Nothing is put together or kept of the
    ids. An empty or null text has 0 bytes and 0 tokens.
    """

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        known = counted_chunks(model)
        counts = []
        for text in batch.column(2).to_pylist():
            known.trim()
            counts.append(sum(map(known.__getitem__, cut(text))))
        return {id_col: batch.column(0), "n_bytes": batch.column(1), "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    kind = df.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    return by_batch(df.select(id_col, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", run)
