import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("quern.llm")

from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from quern.llm import exact_dedup, packing, pieces
from quern.llm.common import ascii_lower
from pyspark.sql import functions as F

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DATA = "/root/testdata/sf0.01"
ODD = ["", None, " ", "   ", "a", "a", " a", "a  b   c ", "\n\n x\t\ty \r\n", "▁ the ▁▁ ▁x", "Ünïcode ñ 漢字 \U0001f600 \x00 é", "<s> </s> <unk> <0x0A> <|endoftext|> x", "x" * 5000, "the " * 9000, "A  <|endoftext|>", "İSTANBUL ÀB AB ab"]
SCHEMA = "doc_id long, text string, lang string, id string, norm string, n string, piece string, length string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", None, "y", "p", "l") for i, t in enumerate(texts)], SCHEMA)


def test_pieces_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    real = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts = ODD + real
    df = rows(spark, texts)
    got = {r.doc_id: r for r in pieces.encode_decode(df, MODEL).collect()}
    counts = {r.doc_id: r for r in pieces.count_tokens(df, MODEL, limit=100).collect()}
    assert len(got) == len(counts) == len(texts)
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == sp.decode(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert (counts[i].n_tokens, counts[i].n_bytes, counts[i].over_limit) == (len(ids), len((t or "").encode()), len(ids) > 100)


def test_random_texts_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own, rng = pieces.chunks(MODEL), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "the", " ", "  ", "▁", "é", "\n", "1", "ing", "\U0001f600", "́", "."]) for _ in range(rng.randrange(12)))
        assert [i for c in pieces.cut(text) for i in own.ids(c)] == sp.encode(text), repr(text)


def test_whole_tokens_are_proven():
    own = pieces.chunks(MODEL)
    whole = own.whole()
    assert len(whole) > 10_000 and all(len(own.ids(w)) == 1 for w in whole)


def test_empty_tables(spark):
    none = rows(spark, ["x"]).limit(0)
    assert pieces.encode_decode(none, MODEL).count() == pieces.count_tokens(none, MODEL).count() == 0
    assert packing.pack_documents(none, RANKS).count() == 0
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_copies(none).count() == 0


def check_packing(found, texts, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_doc) == list(range(len(texts)))
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            part = ids[at : at + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r.length
        assert at == len(ids) and all(r.length == capacity for r in own[1:])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in found)


def test_packing_is_whole_and_tight(spark):
    real = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts = ODD + real
    n, tokens = check_packing(packing.pack_documents(rows(spark, texts), RANKS).collect(), texts, 2048)
    assert n <= -(-tokens // 2048) + 1


def test_long_white_space(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(RANKS, 50256)
    run = "\n" * 1_000_000
    mixed = "\t \r\n\x85\u2003" * 170_000
    texts = [run, f"a{run}", f"{run}b", f"x {run} y's", f"the{' ' * 1_000_000}cat <|endoftext|>{mixed}", f"{mixed}<|endoftext|>{run}é", f"a{mixed}\x1c{' ' * 200_000}b{' ' * 99_999} <|endoftext|>"]
    for text in texts:
        with pytest.raises(ValueError):
            encode.encode_to_numpy(text, allowed_special={packing.SPECIAL})
        assert packing.token_ids(encode, text).tolist() == t.encode(text, add_special_tokens=False).ids
    check_packing(packing.pack_documents(rows(spark, texts[2:4]), RANKS).collect(), texts[2:4], 2048)


def test_cuts_of_white_space_equal_the_library(monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, rng = packing.encoder(RANKS, 50256), random.Random(4)
    monkeypatch.setattr(packing, "LONG_SPACE", re.compile(packing.LONG_SPACE.pattern.replace("100000", "3")))

    class Raises:
        _encode_single_piece = encode._encode_single_piece
        first = True

        def encode_to_numpy(self, text, **more):
            if self.first:
                self.first = False
                raise ValueError
            return encode.encode_to_numpy(text, **more)

    tried = 0
    for _ in range(3000):
        text = "".join(rng.choice(["a", "the", " ", "   ", "\n\n\n", "\t", "\x1c", "\x85", "\u3000", "\u200b", "é", "1", "'s", ".", "<|endoftext|>"]) for _ in range(rng.randrange(14)))
        if packing.LONG_SPACE.search(text):
            tried += 1
            assert packing.token_ids(Raises(), text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    assert tried > 1000


def test_packing_in_many_blocks(spark):
    texts = [("the cat sat " * (i % 97)) for i in range(600)]
    made = packing.token_pieces(rows(spark, texts), RANKS, capacity=256)
    n, tokens = check_packing(packing.pack(made, 256, block=50).collect(), texts, 256)
    assert n <= 1.02 * tokens / 256 + 2


def test_local_search_empties_bins():
    bins = [[0, 1], [2, 3], [4]]
    lengths = [5, 3, 4, 4, 2]
    out = packing.local_search(bins, lengths, 10)
    assert sorted(i for b in out for i in b) == [0, 1, 2, 3, 4]
    assert len(out) == 2 and all(sum(lengths[i] for i in b) <= 10 for b in out)
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))]
        start = packing.best_fit(lengths, 40)
        out = packing.local_search([list(b) for b in start], lengths, 40)
        assert sorted(i for b in out for i in b) == list(range(len(lengths))) and len(out) <= len(start)
        assert all(sum(lengths[i] for i in b) <= 40 for b in out)


def test_exchanges_of_many_short_pieces():
    lengths = [4] * 70 + [3] * 70
    assert packing.exchange([*range(70)], [*range(70, 140)], lengths, 2, 70) == ([0], [70, 139])  # only two for one fill the gap
    rng = random.Random(2)
    for turn in range(300):
        most, copies = rng.randrange(2, 60), 1 if turn % 2 else 30
        lengths = [rng.randrange(1, most) for _ in range(rng.randrange(2, 14))] * copies
        cut, gap, lead = rng.randrange(1, len(lengths)), rng.randrange(1, 20), rng.randrange(-5, 20)
        a, b = [*range(cut)], [*range(cut, len(lengths))]
        mine, yours = (sorted(Counter(lengths[i] for i in x).items()) for x in (a, b))
        twice = [[x + y for k, (x, n) in enumerate(side) for y, _ in side[k if n > 1 else k + 1 :]] for side in (mine, yours)]
        mine, yours = [x for x, _ in mine], [x for x, _ in yours]
        every = {*yours} | {y - x for x in mine for y in [*yours, *twice[1]]} | {y - x for x in twice[0] for y in yours}
        want = max((d for d in every if max(0, -lead) < d <= gap), default=None)
        got = packing.exchange(a, b, lengths, gap, lead)
        assert (got and sum(lengths[i] for i in got[1]) - sum(lengths[i] for i in got[0])) == want
        assert got is None or (len({*got[0]}) == len(got[0]) and {*got[0]} <= {*a} and len({*got[1]}) == len(got[1]) and {*got[1]} <= {*b})


def test_exact_groups(spark):
    texts = ODD + ["hot Copy"] * 300 + ["HOT copy"] * 50 + ["É", "é"]
    df = rows(spark, texts)

    def lower(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_groups(df, keep=keep).collect()
        assert len(got) == len(texts)
        for r in got:
            own = groups[lower(texts[r.doc_id])]
            assert (r.keep_id, r.group_size, r.kept) == (pick(own), len(own), r.doc_id == pick(own))
            assert r.text_sha256 == hashlib.sha256(lower(texts[r.doc_id]).encode()).hexdigest()
        kept = exact_dedup.drop_copies(df, keep=keep)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(pick(g) for g in groups.values())


def test_exact_groups_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (1, "b"), (1, "b"), (1, "c"), (2, None), (None, "")], "doc_id long, text string")
    got = exact_dedup.exact_groups(df, keep="largest").collect()
    assert len(got) == 7
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in got) == sorted([(0, 2, True), (0, 2, True), (1, 2, True), (1, 2, True), (1, 1, True), (2, 2, True), (2, 2, False)])


def test_ascii_lower(spark):
    got = spark.createDataFrame([("ABCÀİ z",), ("ABC Z",)], "t string").select(ascii_lower(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["abcÀİ z", "abc z"]


def test_dropping_copies_sorts_texts_once(spark):
    """A filter for nulls below one of the two uses of the dealt texts would make their exchange twice, and double the disk."""
    df = spark.createDataFrame([(i, f"Text {i % 3}") for i in range(30)], "doc_id long, text string")
    for q in (exact_dedup.exact_groups(df), exact_dedup.drop_copies(df)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            q.collect()
            plan = q._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "ReusedExchange" in plan.split("Initial Plan")[0]
        assert "isnotnull(sha2" not in plan
