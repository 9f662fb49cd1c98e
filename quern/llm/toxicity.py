"""Toxicity by cumulative-link ordinal regression on sparse text features (operator 2)."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_batch, text_or_empty, written

#: Labelled rows that a fit takes at most, by the smallest hash of their id.
SAMPLE = 20_000
#: A feature enters the model if it tells toxic rows from others with this log-likelihood ratio, and in at least so many rows.
EVIDENCE, LEAST = 15.0, 3
#: Features of a model at most (the strongest evidence first), and words whose weight a worker remembers.
FEATURES, KEPT = 4096, 100_000
#: Lengths in bytes of the prefixes of a word that are features beside the word, for stems.
PREFIXES = (4, 5, 6, 7)
GRADES = 3
#: Expected severity from which a text counts as toxic: on held-out labels the highest recall (0.995) without a false alarm.
THRESHOLD = 0.2

#: Lower-cases A-Z and makes every other ASCII character but a-z a space; bytes of other characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> set[bytes]:
    return set(text.encode().translate(LETTERS).split())


def parts(word: bytes) -> list[int]:
    """The features of a word: the crc32 of itself and of its marked prefixes."""
    return [zlib.crc32(word), *(zlib.crc32(b"^%d " % k + word[:k]) for k in PREFIXES if len(word) > k)]


@dataclass(frozen=True)
class Ordinal:
    """P(grade >= k) = sigmoid(sum of the weights of a text's distinct words - threshold k): one set of weights, ordered thresholds."""

    weights: tuple[tuple[int, float], ...]  # by feature
    thresholds: tuple[float, ...]

    def at_least(self, score: float) -> list[float]:
        return [1 / (1 + math.exp(min(60.0, max(-60.0, t - score)))) for t in self.thresholds]


def fit(grades: np.ndarray, rows: np.ndarray, features: np.ndarray, levels: int = GRADES, decay: float = 1e-4, steps: int = 500) -> Ordinal:
    """Maximum likelihood with L2 decay by Adam on all rows. (rows[i], features[i]) says that a row has a feature, repeatedly if several words have it.

    Without rows of a grade, or any at all, its threshold stays far out and the model grades by what it has seen.
    """
    n = len(grades)
    vocabulary, column = np.unique(features, return_inverse=True)
    d = len(vocabulary)
    share = [(np.sum(grades >= k) + 0.1) / (n + 0.2) for k in range(1, levels)]
    start = [math.log((1 - s) / s) for s in share]
    gaps = [math.log(max(b - x, 0.05)) for x, b in zip(start, start[1:], strict=False)]
    theta = np.concatenate([np.zeros(d), [start[0]], gaps])  # thresholds as the first and the logs of the distances
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    each = np.arange(n)
    for step in range(1, steps + 1 if n else 0):
        w, t = theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])
        z = np.bincount(rows, w[column], minlength=n) if d else np.zeros(n)
        above = 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -60, 60)))  # P(grade >= k)
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        at_grade = np.maximum(edge[each, grades] - edge[each, grades + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        dz = (slope[each, grades] - slope[each, grades + 1]) / at_grade
        dt = np.stack([np.where(grades == k, -slope[:, k] / at_grade, 0) + np.where(grades == k - 1, slope[:, k] / at_grade, 0) for k in range(1, levels)]).mean(axis=1)
        gw = np.bincount(column, dz[rows], minlength=d) / n - decay * w if d else np.zeros(0)
        gt = np.concatenate([[dt.sum()], [math.exp(theta[d + j]) * dt[j:].sum() for j in range(1, levels - 1)]])
        g = np.concatenate([gw, gt])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])
    return Ordinal(tuple(zip(vocabulary.tolist(), theta[:d].tolist(), strict=True)), tuple(t.tolist()))


def evident(seen: DataFrame) -> dict[int, bool]:
    """The features of rows (toxic, features) that tell toxic rows from others, by the log-likelihood ratio of their presence, FEATURES at most; and whether toxic rows have them more often."""
    each = seen.select((F.col("toxic") != 0).cast("long").alias("y"), F.explode(F.array_distinct("features")).alias("feature"))
    counts = each.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("a")).filter(F.col("n") >= LEAST)
    total = seen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("toxic") != 0).cast("long")), F.lit(0)).alias("p")).first()
    n, p = F.lit(float(total.n)), F.lit(float(total.p))
    q = n - p

    def part(k, expected):
        return F.when(k > 0, k * F.ln(k / expected)).otherwise(0.0)

    present, absent = F.col("n").cast("double"), n - F.col("n")
    a = F.col("a").cast("double")
    ratio = 2 * (part(a, present * p / n) + part(present - a, present * q / n) + part(p - a, absent * p / n) + part(q - present + a, absent * q / n))
    best = counts.select("feature", ratio.alias("ratio"), (a * n > present * p).alias("more")).filter(F.col("ratio") >= EVIDENCE).orderBy(F.col("ratio").desc(), "feature").limit(FEATURES)
    return {r.feature: r.more for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Fits severity grades on at most `sample` labelled rows: 0 not toxic, 1 toxic, 2 toxic with more than the median of the words that toxic rows have more often.

    The rows are those of the smallest hash of the id, so the same at each run; ids and labels that are
    null are left out. Repeated labels and documents count repeatedly, up to `sample` in all. The driver gets the chosen features of these rows,
    and no texts.
    """
    told = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    few = told.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(few), "_id")  # at most `sample` rows

    def features(batch: pa.RecordBatch) -> dict[str, list]:
        return {"toxic": batch.column(0), "features": [np.array([x for w in words(t) for x in parts(w)], np.int64) for t in batch.column(1).to_pylist()]}

    seen = written(by_batch(texts.select("toxic", "text"), "toxic int, features array<long>", features), "labelled")
    if seen.count() > sample:  # documents that repeat an id
        seen = written(seen.orderBy(F.xxhash64("features"), "toxic").limit(sample), "labelled")
    chosen = evident(seen)
    known = np.array(sorted(chosen), np.int64)

    def only(batch: pa.RecordBatch) -> dict[str, list]:
        lists = batch.column(1)
        own = np.isin(lists.flatten().to_numpy(), known)
        ends = np.concatenate([[0], np.cumsum(own)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return {"toxic": batch.column(0), "features": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.flatten().filter(pa.array(own)))}

    got = by_batch(seen, "toxic int, features array<long>", only).toArrow()
    toxic, found = got["toxic"].to_numpy() != 0, got["features"].to_pylist()
    strength = np.array([sum(chosen[x] for x in own) for own in found], np.int64)  # of the chosen features alone
    some = strength[toxic & (strength > 0)]
    grades = np.where(toxic, np.where(strength > (np.median(some) if len(some) else 0), 2, 1), 0)
    return fit(grades, np.repeat(np.arange(len(grades)), [len(x) for x in found]), np.array([x for own in found for x in own], np.int64))


class Weights(dict):
    """The weight of each word met, by the word."""

    def __init__(self, model: Ordinal):
        self.by_feature = dict(model.weights)

    def __missing__(self, word: bytes) -> float:
        if len(self) > KEPT:
            self.clear()
        found = self[word] = sum(self.by_feature.get(x, 0.0) for x in parts(word))
        return found


@cache
def weights(model: Ordinal) -> Weights:
    return Weights(model)


def severity(df: DataFrame, model: Ordinal, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Grades every whole text: id, severity (the expected grade), p_toxic (of a grade of 1 or more), grade (the likeliest), toxic (severity >= threshold).

    A null or empty text has no features and gets what the thresholds say; repeated rows give repeated rows.
    """

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        chances = [model.at_least(sum(map(weights(model).__getitem__, words(t)))) for t in batch.column(1).to_pylist()]
        expected = [sum(c) for c in chances]
        likeliest = [max(range(len(c) + 1), key=lambda k: (([1.0, *c, 0.0][k] - [1.0, *c, 0.0][k + 1]), -k)) for c in chances]
        return {id_col: batch.column(0), "severity": expected, "p_toxic": [c[0] for c in chances], "grade": likeliest, "toxic": [e >= threshold for e in expected]}

    kind = df.schema[id_col].dataType.simpleString()
    return by_batch(df.select(id_col, text_or_empty(text_col).alias("_text")), f"`{id_col}` {kind}, severity double, p_toxic double, grade int, toxic boolean", run)


def drop_toxic(df: DataFrame, model: Ordinal, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose expected severity is below the threshold. Rows pass through one task each and aren't shuffled."""
    place = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            known = weights(model)
            keep = [sum(model.at_least(sum(map(known.__getitem__, words(t or ""))))) < threshold for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
