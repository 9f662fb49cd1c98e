"""Language-model scoring by a weighted backoff automaton (operator 7)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import partitions, text_or_empty, written
from quern.llm.ngram_join import FACTORS, U64, hashes, mix
from quern.llm.packed import packed_counts, packed_keys, ranges, runs, unpacked_counts, unpacked_keys

#: Discount of a count where the corpus tells none, and the most that it may be.
DISCOUNT, MOST = 0.75, 0.95
#: The triples of the model are those whose two pairs both occur so often in training, and the weight of the failure arc of a state of two words.
LEAST, FAILURE = 2, 0.4
#: Counts of a word from which it is asked how many distinct words follow it: one of a lesser count begins as many pairs as it is counted, as every word has a token after it and the end that comes before a text's first word is counted once a text.
LEAST_FANS = 2
#: Bytes of text from which a part is full. A longer text is a part of its own.
PART = 8 << 20
#: Tokens that one lane walks.
LANE = 512
#: The token after a text's words, which is also the context of its first word. Words never hold a space.
END = U64(xxhash.xxh3_64_intdigest(b" "))
WORDS, PAIRS, TRIPLES, FANS = range(4)


def tokens(text: bytes) -> np.ndarray:
    words = text.lower().split()
    out = np.fromiter(map(hashes().__getitem__, words), U64, len(words))
    return np.append(out, END)


def held_out(key: object) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def distinct_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, at.astype(np.int32)


class Part:
    """The tokens of a part's texts, one text after the other; its distinct words and pairs by ascending key, and which of them ends at each token."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = ids
        each = [tokens(t) for t in texts]
        self.sizes = np.array([len(x) for x in each])
        self.held = np.array([held_out(k) for k in ids])
        self.starts = np.cumsum(self.sizes) - self.sizes
        words = np.concatenate(each)
        del each
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[self.starts] = END
        pairs = mix(before * FACTORS[2] + words)
        self.training = np.repeat(~self.held, self.sizes)
        self.keys, self.at = {}, {}
        self.keys[WORDS], self.at[WORDS] = distinct_of(words)
        self.keys[PAIRS], self.at[PAIRS] = distinct_of(pairs)
        self.end = int(np.searchsorted(self.keys[WORDS], END))
        self.source = np.empty_like(self.at[WORDS])  # the word before each token, at a text's start the end
        self.source[1:] = self.at[WORDS][:-1]
        self.source[self.starts] = self.end

    def counts(self, kind: int) -> np.ndarray:
        """Of each key its count in the training texts."""
        at = self.at[kind]
        use = self.training if kind != TRIPLES else self.training & (at >= 0)
        return np.bincount(at[use], minlength=len(self.keys[kind]))

    def fans(self, pairs: np.ndarray) -> np.ndarray:
        """Of each word this part's share in the number of distinct pairs that it begins: each pair's occurrences add up to 1."""
        at = self.at[PAIRS][self.training]
        return np.bincount(self.source[self.training], 1.0 / pairs[at], minlength=len(self.keys[WORDS]))

    def find_triples(self, pairs: np.ndarray) -> None:
        """Adds the triples both of whose pairs are counted LEAST times; -1 at tokens that end none."""
        often = pairs[self.at[PAIRS]] >= LEAST
        ends = often.copy()
        ends[1:] &= often[:-1]
        ends[self.starts] = False
        place = np.flatnonzero(ends)
        words, known = self.keys[WORDS], self.keys[PAIRS]
        self.keys[TRIPLES], at = distinct_of(mix(known[self.at[PAIRS][place - 1]] * FACTORS[2] + words[self.at[WORDS][place]]))
        self.at[TRIPLES] = np.full(len(ends), -1, np.int32)
        self.at[TRIPLES][place] = at


class Smoothing:
    """What holds for the whole model: the training tokens, all words of the corpus, the discounts."""

    def __init__(self, sums: dict[int, list[int]]):
        seen, self.total, self.types, *words = sums.get(WORDS) or [0] * 5
        self.distinct = seen
        self.word_discount = self.discount(*words)
        self.pair_discount = self.discount(*(sums.get(PAIRS) or [0] * 5)[3:])

    @staticmethod
    def discount(once: int, twice: int) -> float:
        """Ney's estimate from how many are counted once and twice."""
        return min(MOST, once / (once + 2 * twice)) if once else DISCOUNT

    def unigrams(self, counts: np.ndarray) -> np.ndarray:
        """What is discounted goes to all words of the corpus alike, so all of them, those that training lacks too, sum to 1."""
        if not self.total:
            return np.full(len(counts), 1.0 / max(1, self.types))
        return (np.maximum(counts - self.word_discount, 0) + self.word_discount * self.distinct / self.types) / self.total


class Automaton:
    """The model as far as a part's texts can follow it.

    States are the contexts: pairs counted LEAST times in training, words counted at all, and the root. An arc
    of a state is a word that training has after it; its weight is log10 of the smoothed probability,
    for words (c(vw) - discount) / c(v) + back(v) p(w), for pairs (1 - FAILURE) c(uvw) / c(uv) + FAILURE p(w | v).
    Any other word takes the failure arc, of weight back(v) = discount * (distinct words after v) / c(v), or
    FAILURE, to the state of one word less, where it is looked up again. The root has all words. So the weights
    of a word's state sum to 1 over all words, those of a pair's to 1 at most. The arc of a word leads to the state of the longest
    context that ends with it.
    """

    def __init__(self, part: Part, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, fans: np.ndarray, rule: Smoothing):
        self.part = part
        at, source = part.at, part.source
        p1 = rule.unigrams(words)
        context = np.maximum(words, 1)
        back = np.where(words > 0, rule.pair_discount * np.minimum(fans, words) / context, 1.0)
        first = np.zeros(len(pairs), np.int64)
        first[at[PAIRS]] = np.arange(len(at[PAIRS]))  # a place of each pair
        v, w = source[first], at[WORDS][first]
        p2 = np.where(pairs > 0, (pairs - rule.pair_discount) / context[v], 0) + back[v] * p1[w]
        place = np.zeros(len(triples), np.int64)
        some = np.flatnonzero(at[TRIPLES] >= 0)
        place[at[TRIPLES][some]] = some
        p3 = (1 - FAILURE) * triples / np.maximum(pairs[at[PAIRS][place - 1]], 1) + FAILURE * p2[at[PAIRS][place]] if len(triples) else np.zeros(0)
        #: Weights of the arcs; NaN where training has none, -1 in `at` where the automaton has none.
        self.root = np.log10(p1)
        self.word_arcs = np.where(pairs > 0, np.log10(p2), np.nan)
        self.pair_arcs = np.append(np.where(triples > 0, np.log10(np.maximum(p3, 1e-300)), np.nan), np.nan)
        self.word_failure = np.log10(back)
        self.is_state = [np.ones(len(words), bool), words > 0, pairs >= LEAST]

    def after(self, place: np.ndarray) -> np.ndarray:
        """How many words the state remembers that the token at each place leads to."""
        at = self.part.at
        return np.where(self.is_state[2][at[PAIRS][place]], 2, np.where(self.is_state[1][at[WORDS][place]], 1, 0)).astype(np.int8)

    def scores(self) -> np.ndarray:
        """The log10 probability of each text: one walk from left to right carries the state and adds up the weights.

        Many lanes walk at once, each over LANE tokens of one text. The lane that goes on in a text first walks the
        two tokens before it from the root, without adding up, which leads to the state in which the lane before it ended.
        """
        part, size = self.part, LANE
        pieces = -(-part.sizes // size)
        owner = np.repeat(np.arange(len(part.sizes)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = part.starts[owner] + nth * size
        length = np.minimum(size, part.sizes[owner] - nth * size)
        order = np.argsort(-length, kind="stable")
        owner, nth, begin, length = owner[order], nth[order], begin[order], length[order]
        state = np.where(nth == 0, self.is_state[1][part.end], 0).astype(np.int8)  # a text begins in the state of the end, which came before
        for back in (2, 1):
            go = np.flatnonzero(nth > 0)
            state[go] = self.after(begin[go] - back)
        total = np.zeros(len(owner))
        at, source = part.at, part.source
        for t in range(int(length[0])):
            k = int(np.searchsorted(-length, -t, "left"))  # lanes longer than t
            place = begin[:k] + t
            remembers = state[:k]
            weight = np.zeros(k)
            arc = np.where(remembers == 2, self.pair_arcs[at[TRIPLES][place]], np.nan)
            none = np.isnan(arc)
            weight[none & (remembers == 2)] = np.log10(FAILURE)  # the failure arc of a pair
            arc = np.where(none & (remembers >= 1), self.word_arcs[at[PAIRS][place]], arc)
            none = np.isnan(arc)
            weight += np.where(none & (remembers >= 1), self.word_failure[source[place]], 0)  # that of a word
            total[:k] += weight + np.where(none, self.root[at[WORDS][place]], arc)
            state[:k] = self.after(place)
        return np.bincount(owner, total, minlength=len(part.sizes))


def summed(answers: DataFrame) -> dict[int, list[int]]:
    """Of each kind the sums that the tasks of its ranges have told: five numbers a kind."""
    each = answers.filter("part = -1").select("kind", F.posexplode("sums").alias("at", "n")).groupBy("kind", "at").agg(F.sum("n").alias("n"))
    out: dict[int, list[int]] = {}
    for r in sorted(each.collect()):
        out.setdefault(r["kind"], []).append(r["n"])
    return out


ASKED = "range int, kind int, part long, keys binary, counts binary"
ANSWERED = "part long, kind int, range int, n long, answer binary, sums array<long>"


def asks(number: int, spread: int, kind: int, keys: np.ndarray, packed) -> pa.RecordBatch:
    some, cut = ranges(keys, spread)
    columns = [pa.array(some, pa.int32()), pa.array([kind] * len(some), pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array([packed_keys(keys[c]) for c in cut], pa.binary()), pa.array([packed(c) for c in cut], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["range", "kind", "part", "keys", "counts"])


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up what all parts have of the keys of a range, and tells each part of its own keys, in their order. A row for part -1 has sums of the range."""
    for (number, kind), rows in runs(batches, 2):
        parts, found, counts = [], [], []
        for _, _, part, keys, count in rows:
            parts.append(part)
            found.append(unpacked_keys(keys))
            counts.append(np.frombuffer(count, "<f8") if kind == FANS else unpacked_counts(count, len(found[-1])))
        ends = np.cumsum([len(x) for x in found])[:-1]
        distinct, at = np.unique(np.concatenate(found), return_inverse=True)
        del found
        total = np.rint(np.bincount(at, np.concatenate(counts), minlength=len(distinct))).astype(np.int64)
        answers = [packed_counts(x) for x in np.split(total[at], ends)]
        sums = [int((total > 0).sum()), int(total.sum()), len(distinct), int((total == 1).sum()), int((total == 2).sum())]
        k = len(parts) + 1
        columns = [pa.array([*parts, -1], pa.int64()), pa.array([kind] * k, pa.int32()), pa.array([number] * k, pa.int32()), pa.array([*np.diff([0, *ends, len(at)]).tolist(), 0], pa.int64()), pa.array([*answers, b""], pa.binary()), pa.array([*[None] * (k - 1), sums], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "kind", "range", "n", "answer", "sums"])


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text with a model of order 3 of those whose crc32(id as text) mod 10 isn't 0 (a null id: the empty text's, 0).

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score and score. A null or empty text is
    its end token alone. Repeated rows and ids each count. Other columns are ignored.

    No task or driver holds the model. Texts are written once, in parts of some PART bytes. A
    part asks for its distinct words and pairs, with its training counts, by ranges of their 64-bit hashes,
    so no word or pair is hot: each part sends it once. The tasks of the ranges add up the counts and
    answer each part in its own order. With these a part asks likewise for its triples, as far as both their pairs
    occur LEAST times in training (others aren't in the model), and for how many distinct words follow each of
    its words that is counted LEAST_FANS times. Then it builds the automaton that its texts can follow.
    """
    import zstandard
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    kind_of_id, name = to_arrow_type(df.schema[id_col].dataType), df.schema[id_col].dataType.simpleString()

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, k = [], [], 0, TaskContext.get().partitionId() << 32

        def lot() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], "<i8").tobytes()
            packed = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(kind_of_id)), pa.array([lengths], pa.binary()), pa.array([packed], pa.binary())], names=["part", "bytes", "ids", "lengths", "texts"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(key)
                texts.append(text.encode())
                size += len(texts[-1])
                if size >= PART:
                    yield lot()
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield lot()

    def unpacked(ids: list, lengths: bytes, texts: bytes) -> Part:
        ends = np.cumsum(np.frombuffer(lengths, "<i8"))
        data = zstandard.ZstdDecompressor().decompress(texts, max_output_size=int(ends[-1])) if ends[-1] else b""
        return Part(ids, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])

    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    parts = written(docs.mapInArrow(lots, f"part long, bytes long, ids array<{name}>, lengths binary, texts binary"), "parts")
    told = parts.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    n, spread = max(1, told["n"]), max(partitions(spark), -(-(told["bytes"] or 0) // (8 * PART)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, lengths, texts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                part = unpacked(ids, lengths, texts)
                for kind in (WORDS, PAIRS):
                    counts = part.counts(kind)
                    yield asks(number, spread, kind, part.keys[kind], lambda c, counts=counts: packed_counts(counts[c]))

    def answered(asked: DataFrame, what: str) -> DataFrame:
        return written(asked.repartition(spread, "range").sortWithinPartitions("range", "kind").mapInArrow(answer, ANSWERED), what)

    blank = F.lit(None)
    read = parts.select("part", F.lit(1).alias("is_text"), F.lit(0).alias("kind"), F.lit(0).alias("range"), F.lit(0).cast("long").alias("n"), blank.cast("binary").alias("answer"), "ids", "lengths", "texts")

    def with_answers(answers: DataFrame) -> DataFrame:
        """The rows of a part together: its answers by kind and range, then its texts."""
        rows = answers.filter("part >= 0").select("part", F.lit(0).alias("is_text"), "kind", "range", "n", "answer", blank.cast(f"array<{name}>").alias("ids"), blank.cast("binary").alias("lengths"), blank.cast("binary").alias("texts"))
        return rows.unionByName(read).repartition(n, "part").sortWithinPartitions("part", "is_text", "kind", "range")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part, dict[int, np.ndarray]]]:
        for (number,), rows in runs(batches, 1):
            got: dict[int, list[np.ndarray]] = {}
            for _, is_text, kind, _, n_keys, data, ids, lengths, texts in rows:
                if is_text:
                    yield number, unpacked(ids, lengths, texts), {k: np.concatenate(x) for k, x in got.items()}
                else:
                    got.setdefault(kind, []).append(unpacked_counts(data, n_keys))

    first = answered(parts.select("part", "ids", "lengths", "texts").mapInArrow(ask, ASKED), "answers")
    rule = Smoothing(summed(first))

    def ask_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, got in met(batches):
            often = got[WORDS] >= LEAST_FANS
            fans = part.fans(got[PAIRS])[often]
            yield asks(number, spread, FANS, part.keys[WORDS][often], lambda c, fans=fans: fans[c].astype("<f8").tobytes())
            part.find_triples(got[PAIRS])
            counts = part.counts(TRIPLES)
            yield asks(number, spread, TRIPLES, part.keys[TRIPLES], lambda c, counts=counts: packed_counts(counts[c]))

    second = answered(with_answers(first).mapInArrow(ask_more, ASKED), "more")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, got in met(batches):
            part.find_triples(got[PAIRS])
            words = got[WORDS]
            fans = words.copy()
            fans[words >= LEAST_FANS] = got.get(FANS, np.zeros(0, np.int64))
            model = Automaton(part, words, got[PAIRS], got.get(TRIPLES, np.zeros(0, np.int64)), fans, rule)
            base = np.log10((words + 0.1) / (rule.total + 0.1 * (rule.distinct + 1)))[part.at[WORDS]]
            known = (words > 0).astype(np.int64)[part.at[WORDS]]
            columns = [pa.array(part.ids, kind_of_id), pa.array(part.held.tolist()), pa.array(part.sizes, pa.int64()), pa.array(np.add.reduceat(known, part.starts)), pa.array([rule.total] * len(part.ids), pa.int64()), pa.array(np.add.reduceat(base, part.starts)), pa.array(model.scores())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = with_answers(first.unionByName(second)).mapInArrow(follow, f"id {name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
