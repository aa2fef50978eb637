"""Severity of toxic language by cumulative-link ordinal regression.

Grades 0 < 1 < ... share one weight vector over sparse features and differ only in ordered
thresholds: ``P(grade > k) = sigmoid(w.x - t_k)``.  The expected severity is the sum of these
chances.  The labels say only whether a text is toxic; toxic texts are graded by how many
features they have that occur in toxic texts alone, cut at the quantiles of that number.

Features of a text are its distinct words and their beginnings of four and five letters, so that
inflected forms share evidence.  The dictionary and the weights come from at most `SAMPLE`
labelled texts (of either label, up to half of it: those with the smallest hashes of their ids, of several rows of an id one,
weighted by how many such labels there are) and hold at most `FEATURES` entries, so what tasks
and driver receive is bounded.  Scoring is a map over all texts without a shuffle.

Null and empty texts have no features and get the severity of such a text.  Without toxic labels
every severity is 0.  Repeated rows are scored each; other columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import hashing
from pagewright.session import map_batches, scratch_folder

#: Bound of the labelled sample, of the dictionary and of the words that a feature must occur in
SAMPLE, FEATURES, LEAST_TEXTS = 10_000, 4_096, 3
GRADES = 3
STEPS, RATE, DECAY = 400, 0.1, 1e-5
#: A feature is kept if toxic texts have it this many times as often as others, or the reverse
LEAST_RATIO = 4.0
#: Least chi-square of a feature, so that chance features of long texts stay out
LEAST_CHI = 24.0
PREFIXES = (4, 5)

_WORD = re.compile(r"[^\W\d_]+")


def text_features(text: str | None) -> set[str]:
    """Distinct words and word beginnings (marked with a star)."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for size in PREFIXES:
        out.update(w[:size] + "*" for w in words if len(w) >= size)
    return out


@dataclass
class Model:
    weight: dict[str, float]
    thresholds: np.ndarray
    #: Texts whose chance of any grade above 0 reaches this are toxic
    cut: float = 0.5

    def severity(self, text: str | None) -> tuple[float, float]:
        """Chance of any grade above 0, and the expected grade."""
        weight = self.weight
        found = weight.keys() & text_features(text)
        # Added in a fixed order: a set has none, and sums of floats depend on it.
        chances = _sigmoid(sum(weight[f] for f in sorted(found)) - self.thresholds)
        return float(chances[0]), float(chances.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def grades_of(toxic: np.ndarray, strong: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grade 0 for clean texts; toxic ones by quantiles of their number of toxic-only features."""
    if not toxic.any():
        return np.zeros(len(toxic), dtype=np.int64)
    cuts = np.quantile(strong[toxic], np.arange(1, grades - 1) / (grades - 1))
    return np.where(toxic, 1 + np.searchsorted(cuts, strong, "left"), 0)


def likelihood_slopes(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of each row's log-likelihood by its score and by the thresholds.

    `p` holds P(grade > k) per row.  A row of grade y has chance P(> y-1) - P(> y).
    """
    wide = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1)
    slope = wide * (1 - wide)
    at = np.arange(len(p))
    mass = np.maximum(wide[at, y] - wide[at, y + 1], 1e-9)
    high, low = slope[at, y] / mass, slope[at, y + 1] / mass
    by_threshold = np.zeros_like(wide)
    by_threshold[at, y] -= high
    by_threshold[at, y + 1] += low
    return high - low, by_threshold[:, 1:-1]


def fit(row: np.ndarray, col: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, grades: int = GRADES):
    """Weights and thresholds of largest likelihood; row and col say which text has which feature."""
    above = (y[:, None] > np.arange(grades - 1)).astype(float)
    rate = np.clip(weight @ above / weight.sum(), 1e-4, 1 - 1e-4)
    start = np.log((1 - rate) / rate)
    # Thresholds stay in order: the first one, then steps that are exponentials.
    at = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, STEPS + 1):
        w, g = at[:width], at[width:]
        thresholds = np.cumsum(np.concatenate([g[:1], np.exp(g[1:])]))
        p = _sigmoid(np.bincount(row, w[col], len(y))[:, None] - thresholds)
        by_score, by_threshold = likelihood_slopes(p, y)
        after = np.cumsum((weight @ by_threshold)[::-1])[::-1]
        grad = -np.concatenate([
            np.bincount(col, (by_score * weight)[row], width), after[:1], after[1:] * np.exp(g[1:])]) / weight.sum()
        grad[:width] += DECAY * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        at = at - RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    w, g = at[:width], at[width:]
    return w, np.cumsum(np.concatenate([g[:1], np.exp(g[1:])]))


def best_cut(chance: np.ndarray, toxic: np.ndarray) -> float:
    """The chance that separates toxic from clean texts with fewest errors, amid its gap."""
    order = np.argsort(chance, kind="stable")
    ordered, bad = chance[order], toxic[order]
    # Errors of a cut before each place: toxic ones below and clean ones from there on.
    errors = np.concatenate([[0], np.cumsum(bad)]) + np.concatenate([np.cumsum(~bad[::-1])[::-1], [0]])
    edges = np.concatenate([[0.0], ordered, [1.0]])
    # No cut fits between equal chances.
    errors = np.where(np.diff(edges) > 1e-6, errors, len(order) + 1)
    gap = np.where(errors == errors.min(), np.diff(edges), -1)
    best = int(np.argmax(gap))
    return float((edges[best] + edges[best + 1]) / 2)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grades: int = GRADES) -> Model | None:
    """Fit on a bounded sample of labelled documents; None without toxic ones."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(1):
        return None
    half = [hashing.smallest_hashes(known.where(F.col("toxic") == value), "doc_id", sample // 2) for value in (0, 1)]
    # At most `sample` rows: the bound that makes the broadcast safe.
    rows = hashing.one_text_each(docs.select("doc_id", "text").join(F.broadcast(half[0].unionByName(half[1])), "doc_id"))

    def find(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                found = [sorted(text_features(t)) for t in part.column("text").to_pylist()]
                yield pa.record_batch(
                    [part.column("toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.string()))], ["toxic", "found"])

    folder = scratch_folder(spark, "toxic-sample")
    map_batches(rows, find, "toxic int, found array<string>").write.parquet(folder)
    texts = spark.read.parquet(folder)
    have = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not have.get(1):
        return None
    n1, n0 = have[1], max(1, have.get(0, 0))
    # Chi-square of each feature against the label, computed where the features are.
    counted = texts.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("a"), F.sum(F.expr("1 - toxic")).alias("b")).where(f"a + b >= {LEAST_TEXTS}")
    ratio = f"((a + 0.5D) / {n1}) / ((b + 0.5D) / {n0})"
    expected = f"((a + b) * {n1}D / {n1 + n0})"
    chosen = counted.where(f"{ratio} >= {LEAST_RATIO} OR {ratio} <= 1 / {LEAST_RATIO}D").selectExpr(
        "f", "a", "b", f"pow(a - {expected}, 2) / {expected} AS chi").where(f"chi >= {LEAST_CHI}").orderBy(F.desc("chi"), "f").limit(FEATURES).collect()
    if not chosen:
        return None
    index = {r["f"]: i for i, r in enumerate(chosen)}
    only = {r["f"] for r in chosen if not r["b"]}

    def look(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = batch.column("found").to_pylist()
            yield pa.record_batch(
                [batch.column("toxic"), pa.array([sorted(index[f] for f in t if f in index) for t in found], pa.list_(pa.int32())),
                 pa.array([sum(f in only for f in t) for t in found], pa.int32())],
                ["toxic", "cells", "strong"])

    got = map_batches(texts, look, "toxic int, cells array<int>, strong int").collect()
    got.sort(key=lambda r: (r["toxic"], r["strong"], r["cells"]))
    toxic = np.array([r["toxic"] == 1 for r in got])
    y = grades_of(toxic, np.array([r["strong"] for r in got]), grades)
    row = np.repeat(np.arange(len(got)), [len(r["cells"]) for r in got])
    col = np.array([c for r in got for c in r["cells"]], dtype=np.int64)
    weight = np.where(toxic, total[1] / n1, total.get(0, 0) / n0)
    w, thresholds = fit(row, col, y, weight, len(index), grades)
    chance = _sigmoid(np.bincount(row, w[col], len(got)) - thresholds[0])
    return Model({f: float(w[i]) for f, i in index.items()}, thresholds, best_cut(chance, toxic))


def _cut(model: Model | None, threshold: float | None) -> float:
    return threshold if threshold is not None else model.cut if model else 0.5


def _severities(model: Model | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros((len(column), 2))
    return np.array([model.severity(t) for t in column.to_pylist()], dtype=float).reshape(-1, 2)


def score(docs: DataFrame, model: Model | None, threshold: float | None = None) -> DataFrame:
    """doc_id, chance of being toxic, expected severity and the decision for every document."""
    threshold = _cut(model, threshold)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                value = _severities(model, part.column("text"))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(value[:, 0]), pa.array(value[:, 1]), pa.array(value[:, 0] >= threshold)],
                    ["doc_id", "chance", "severity", "toxic"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, chance double, severity double, toxic boolean")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float | None = None) -> DataFrame:
    """The rows whose chance of being toxic is below `threshold` (the model's cut), all columns as they are."""
    if model is None:
        return docs
    threshold = _cut(model, threshold)
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            batch = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for part in hashing.slices(batch, str(place)):
                keep = _severities(model, part.column(place))[:, 0] < threshold
                yield part.filter(pa.array(keep)).rename_columns(names)

    return map_batches(docs, run, docs.schema)
