"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): all thresholds share the weights w, and theta grows with k. x tells which features a text has: hashed
words and beginnings of words (a stem with any ending). The output is the expected severity, the mean of the grade's distribution.

The model is fitted on a bounded sample of labelled rows (``per_grade`` of each grade, chosen by a hash of the id); features are those of
``FEATURES`` that differ most between graded and clean rows of the sample. Prediction covers every whole text in one pass of the scan.

Defined results: null and blank texts have no features and get the severity of a text without marks; labels with a null id or grade are
ignored, and the highest grade holds where an id has several; without two different grades in the sample every severity is 0; a
null id or repeated rows are predicted like any other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxloom.functions.ranking import top_n
from voxloom.llm import kernels as K
from voxloom.session import durable

#: Hash range of features, how many are kept, and the lengths of word beginnings in bytes.
RANGE, FEATURES, HEADS = 1 << 20, 4096, (4, 5, 6)
#: A kept feature's shares of graded and clean rows differ by so many standard deviations (chance gives none of a million) and by this
#: factor: what only goes with long texts differs by far less.
CLEAR, FACTOR = 5.0, 5.0
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Model:
    """Kept features (sorted), their weights, and the thresholds between the grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def spread(self, score: np.ndarray) -> np.ndarray:
        """Probability of every grade, one row per score."""
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))
        below = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        return np.diff(below, axis=1)


def features(part: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their documents; both may repeat."""
    low = K.LOWER[part.data]
    letters = _LETTER[low]
    bounds = np.zeros(len(low) + 1, bool)
    bounds[part.offsets] = True
    start = np.flatnonzero(letters & ~(np.concatenate([[False], letters[:-1]]) & ~bounds[:-1])) if len(low) else np.zeros(0, np.int64)
    end = np.flatnonzero(letters & ~(np.concatenate([letters[1:], [False]]) & ~bounds[1:])) + 1 if len(low) else start
    owner = np.searchsorted(part.offsets, start, "right") - 1
    prefix = K.prefix_hash(K.byte_values(low))
    found, owners = [K.span_hash(prefix, start, end)], [owner]
    for n in HEADS:
        longer = end - start > n
        found.append(K.mix64(K.span_hash(prefix, start[longer], start[longer] + n)))
        owners.append(owner[longer])
    numbers = (np.concatenate(found) % np.uint64(RANGE)).astype(np.int64)
    return numbers, np.concatenate(owners)


def fit(docs: DataFrame, grades: DataFrame, per_grade: int = 2000, id: str = "doc_id", text: str = "text", grade: str = "grade") -> Model | None:
    """A model from the rows of `docs` whose id has a grade (0 is clean); None without two grades.

    A grade's share is its number of ids; a column `stands` of `grades` tells how many ids each of them counts for.
    """
    stands = F.col("stands") if "stands" in grades.columns else F.lit(1.0)
    graded = grades.where(F.col(id).isNotNull() & F.col(grade).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(
        F.max(F.col(grade).cast("int")).alias("grade"), F.max(stands).alias("stands"))
    ids = docs.select(F.col(id).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    chosen = durable(top_n(graded.join(ids, "id"), ("grade",), [F.xxhash64("id"), F.col("id")], per_grade).select("id", "grade"))
    shares = {r["grade"]: r["count"] * r["stands"] for r in graded.groupBy("grade").agg(F.count("*").alias("count"), F.max("stands").alias("stands")).collect()}
    if chosen.select("grade").distinct().count() < 2:
        return None
    # at most per_grade rows of two numbers per grade
    texts = docs.select(F.col(id).cast("long").alias("id"), F.lower(text).alias("text")).join(F.broadcast(chosen), "id")
    marked = durable(texts.select("grade", "text").mapInArrow(_marks, "grade int, marks array<int>"))
    counts = marked.select((F.col("grade") > 0).cast("int").alias("bad"), F.explode("marks").alias("feature")).groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    total = marked.agg(F.sum((F.col("grade") > 0).cast("int")), F.count("*")).first()
    bad, good = max(total[0], 1), max(total[1] - total[0], 1)
    share, other = F.col("bad") / bad, F.col("good") / good
    spread = F.sqrt((F.col("bad") + F.col("good")) / (bad + good) * (1 / bad + 1 / good))
    clear = F.abs(share - other) / spread
    apart = F.greatest(share, other) >= FACTOR * F.least(share, other)
    kept = counts.where((F.col("bad") + F.col("good") >= 3) & (clear >= CLEAR) & apart).orderBy(F.desc(clear), "feature").limit(FEATURES)
    numbers = np.sort(np.array([r.feature for r in kept.select("feature").collect()], np.int64))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.flatnonzero(np.isin(numbers, row)).astype(np.int32) for row in batch.column("marks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(rows, pa.list_(pa.int32()))], names=["grade", "marks"])

    sample = marked.mapInArrow(only, "grade int, marks array<int>").toArrow()
    rows = sample.column("marks").to_pylist()
    known = sorted(set(sample.column("grade").to_pylist()))
    target = np.searchsorted(known, np.array(sample.column("grade")))
    weights, thresholds = _solve(rows, target, np.array([shares[g] for g in known], float), len(numbers))
    used = np.abs(weights) > 1e-4
    return Model(numbers[used], weights[used], thresholds)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch.column("text"), 1 << 18):
            number, owner = features(part)
            pairs = np.unique(owner * RANGE + number)
            ends = np.searchsorted(pairs, np.arange(len(part) + 1) * RANGE)
            yield pa.RecordBatch.from_arrays([
                batch.column("grade").slice(part.lo, len(part)),
                pa.ListArray.from_arrays(ends.astype(np.int32), (pairs % RANGE).astype(np.int32))], names=["grade", "marks"])


def _solve(rows: list[list[int]], target: np.ndarray, shares: np.ndarray, width: int, rounds: int = 600, price: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised log-loss, grades weighted by their shares of all labels.

    Adam with soft thresholds on the whole sample. A weight costs as much as ``price`` graded rows, so a feature that only marks rows
    explained by others (words of a few copies of a toxic text) gets none.
    """
    grades = len(shares)
    column = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weight = (shares / shares.sum() / np.bincount(target, minlength=grades))[target]
    first = np.linspace(0, grades - 2, grades - 1) - (grades - 2) / 2
    value = np.concatenate([np.zeros(width), first[:1], np.zeros(grades - 2)])  # steps between thresholds are exponentials
    cost = price * weight[target > 0].max()
    mean, square = np.zeros_like(value), np.zeros_like(value)
    at = np.arange(len(rows))
    for turn in range(1, rounds + 1):
        w, theta = value[:width], value[width] + np.concatenate([[0.0], np.cumsum(np.exp(value[width + 1:]))])
        score = np.bincount(owner, w[column], len(rows))
        below = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -60, 60)))
        padded = np.concatenate([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))], axis=1)
        chance = np.maximum(padded[at, target + 1] - padded[at, target], 1e-12)
        slope = np.concatenate([np.zeros((len(rows), 1)), below * (1 - below), np.zeros((len(rows), 1))], axis=1)
        up, down = weight * slope[at, target + 1] / chance, weight * slope[at, target] / chance
        by_theta = np.bincount(target + 1, -up, grades + 1)[1:grades] + np.bincount(target, down, grades + 1)[1:grades]
        tail = np.cumsum(by_theta[::-1])[::-1]
        grad = np.concatenate([
            np.bincount(column, (up - down)[owner], width), tail[:1], tail[1:] * np.exp(value[width + 1:])])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad ** 2
        pace = 0.1 * (1 - turn / (rounds + 1)) / (np.sqrt(square / (1 - 0.999 ** turn)) + 1e-6)
        value = value - pace * mean / (1 - 0.9 ** turn)
        value[:width] = np.sign(value[:width]) * np.maximum(np.abs(value[:width]) - pace[:width] * cost, 0)
    return value[:width], value[width] + np.concatenate([[0.0], np.cumsum(np.exp(value[width + 1:]))])


def predict(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, severity, grade, p_toxic` per row of `docs`: mean grade, likeliest grade and the probability of a grade above 0."""
    found = annotate(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), model, "text")
    return found.select("doc_id", F.col("_severity").alias("severity"), F.col("_grade").alias("grade"), F.col("_p_toxic").alias("p_toxic"))


def annotate(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with `_severity`, `_grade` and `_p_toxic`; columns of these names are replaced."""
    added = {"_severity": "double", "_grade": "integer", "_p_toxic": "double"}
    docs = docs.drop(*added)
    if model is None:
        return docs.withColumns({c: F.lit(0).cast(kind) for c, kind in added.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, names = batch.columns, batch.schema.names
            scores = [_score(part, model) for part in K.slices(columns[-1], 1 << 18)]
            spread = model.spread(np.concatenate([*scores, np.zeros(0)]))
            yield pa.RecordBatch.from_arrays([
                *columns[:-1], pa.array(spread @ np.arange(spread.shape[1])), pa.array(spread.argmax(axis=1).astype(np.int32)),
                pa.array(1 - spread[:, 0])], names=[*names[:-1], *added])

    schema = docs.schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return docs.select("*", F.lower(text).alias("_low")).mapInArrow(run, schema)


def _score(part: K.Slice, model: Model) -> np.ndarray:
    """Sum of the weights of the kept features that each document has."""
    kept = np.full(RANGE, -1, np.int16)
    kept[model.features] = np.arange(len(model.features))
    number, owner = features(part)
    at = kept[number]
    hit = at >= 0
    pairs = np.unique(owner[hit] * RANGE + at[hit])
    return np.bincount(pairs // RANGE, model.weights[pairs % RANGE], len(part))


def graded(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_grade: int = 2000) -> DataFrame:
    """`doc_id, grade, stands` from labels that only tell toxic from clean: 0 is clean; a bounded sample of toxic rows is 1 or 2, up to and
    above their median number of different marks, the features that speak for toxic in a model of the two classes. Each row of the sample
    stands for as many toxic ids of all labels as make the sample whole, so the classes keep their shares."""
    flat = labels.select(F.col(id).alias("doc_id"), F.col(toxic).cast("int").alias("grade"))
    coarse = fit(docs, flat, per_grade, id, text)
    if coarse is None:
        return flat.withColumn("stands", F.lit(1.0))
    flat = flat.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("grade").alias("grade"))
    bad = flat.where("grade > 0").select("doc_id")
    chosen = durable(top_n(bad.withColumn("k", F.lit(1)), ("k",), [F.xxhash64("doc_id"), F.col("doc_id")], per_grade).select("doc_id"))
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.lower(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    marks = coarse.features[coarse.weights > 0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column("text"), 1 << 18):
                number, owner = features(part)
                hit = np.isin(number, marks)
                hits = np.bincount(np.unique(owner[hit] * RANGE + number[hit]) // RANGE, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.lo, len(part)), pa.array(hits)], names=["doc_id", "n"])

    counts = durable(texts.select("doc_id", "text").mapInArrow(count, "doc_id long, n long"))
    middle = counts.agg(F.percentile_approx("n", 0.5)).first()[0]
    severe = counts.groupBy("doc_id").agg(F.max("n").alias("n")).select("doc_id", F.when(F.col("n") > middle, 2).otherwise(1).alias("grade"))
    stands = bad.count() / max(severe.count(), 1)
    return severe.withColumn("stands", F.lit(stands)).unionByName(flat.where("grade = 0").withColumn("stands", F.lit(1.0)))
