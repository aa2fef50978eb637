"""Quality classifier learned from trusted positives and unlabelled text.

Non-negative positive-unlabelled learning: with class prior p the risk of a linear scorer is
``p * E+[loss(+)] + max(0, Eu[loss(-)] - p * E+[loss(-)])``, so no trusted negatives are
needed.  The prior is estimated from the same two samples: a first scorer tells positives from
unlabelled texts, and the smallest ratio of the two tail shares bounds the prior from above.

Fitting uses at most `SAMPLE` positives and `SAMPLE` unlabelled texts, those with the smallest
hashes of their ids; of several rows of an id one counts.  Scoring is a map over all texts without a shuffle.

Null and empty texts have all features zero and get the score of such a text.  Without any
positive there is no evidence: every score is 0.5 and the filter keeps all rows.  Repeated rows
are scored each; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import hashing
from pagewright.session import map_batches

#: Bound of each of the two samples that the classifier is fitted on
SAMPLE = 20_000
THRESHOLD = 0.7
STEPS, RATE, DECAY = 600, 0.05, 1e-4
#: Slack of the prior's upper bound: smallest share of positives in a tail that counts
LEAST_TAIL = 0.05

_CLASSES = {
    "upper": [b for b in range(65, 91)],
    "letter": [b for b in range(256) if b >= 128 or chr(b).isalpha()],
    "digit": [b for b in range(48, 58)],
    "stop": [ord(c) for c in ".,;:?'\"()-"],
    "shout": [ord("!")],
    "symbol": [ord(c) for c in "*$%#&@^~<>{}[]=+\\/_"],
    "bar": [ord("|")],
    "line": [ord("\n")],
    "high": list(range(128, 256)),
}


def features(column: pa.Array) -> np.ndarray:
    """A row of shape features for every text; all zero for a text without words."""
    data, offsets = hashing.buffer_of(column)
    texts = len(offsets) - 1
    share = {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, np.int8)
        table[members] = 1
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        share[name] = np.diff(sums[offsets]).astype(float)
    begins, ends, text_of = hashing.word_spans(data, offsets)
    words = hashing.word_hashes(data, begins, ends)
    starts = hashing.counts_per_text(text_of, texts)
    n = np.diff(starts).astype(float)
    same = np.zeros(len(words) + 1)
    if len(words) > 1:
        same[2:] = np.cumsum((words[1:] == words[:-1]) & (text_of[1:] == text_of[:-1]))
    repeats = np.diff(same[starts])
    own = words.copy()
    for a, b in zip(starts[:-1], starts[1:]):
        own[a:b].sort()
    fresh = np.zeros(len(words) + 1)
    if len(words):
        new = np.ones(len(words))
        new[1:] = (own[1:] != own[:-1]) | (text_of[1:] != text_of[:-1])
        fresh[1:] = np.cumsum(new)
    distinct = np.diff(fresh[starts])
    per_word, per_byte = 1 / np.maximum(n, 1), 1 / np.maximum(np.diff(offsets), 1)
    length = np.log1p(n)
    base = np.stack([
        share["upper"] / np.maximum(share["letter"], 1), share["letter"] * per_byte, share["digit"] * per_byte,
        share["stop"] * per_word, share["shout"] * per_word, share["symbol"] * per_word, share["bar"] * per_word,
        share["line"] * per_word, share["high"] * per_byte, repeats * per_word, distinct * per_word,
        (1 - distinct * per_word) / np.maximum(length, 1), np.log1p(np.diff(offsets) * per_word), length / 10,
    ], axis=1)
    base[n == 0] = 0
    return np.concatenate([base, np.sqrt(np.abs(base)), np.minimum(base, 5) ** 2], axis=1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Chance of a positive, for each row of features."""
        return _sigmoid(np.clip((rows - self.centre) / self.scale, -8, 8) @ self.weights + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _descend(gradient, width: int) -> np.ndarray:
    """Adam over a vector of weights and a bias."""
    at, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        g = gradient(at) + DECAY * at
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        at = at - RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return at


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of tail shares over all cuts of a positive-against-unlabelled score.

    Above any cut the unlabelled share is at least prior times the positive share, so the
    ratio bounds the prior; a tail must hold `LEAST_TAIL` of the positives to count.
    """
    cuts = np.quantile(positive, np.linspace(0, 1 - LEAST_TAIL, 200))
    ordered_p, ordered_u = np.sort(positive), np.sort(unlabelled)
    tail_p = 1 - np.searchsorted(ordered_p, cuts) / len(positive)
    tail_u = 1 - np.searchsorted(ordered_u, cuts) / len(unlabelled)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((tail_u + slack) / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Minimise the non-negative risk over two samples of feature rows."""
    both = np.concatenate([positive, unlabelled])
    centre, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - centre) / scale, -8, 8) for x in (positive, unlabelled))
    p, u = (np.concatenate([x, np.ones((len(x), 1))], 1) for x in (p, u))
    if prior is None:
        # Every other row learns the first scorer, the rest measure the tails.
        def tell(w, a=p[::2], b=u[::2]):
            return a.T @ (_sigmoid(a @ w) - 1) / len(a) + b.T @ _sigmoid(b @ w) / len(b)

        first = _descend(tell, p.shape[1] - 1)
        prior = estimate_prior(p[1::2] @ first, u[1::2] @ first) if min(len(p), len(u)) > 3 else 0.5

    def gradient(w):
        at_p, at_u = p @ w, u @ w
        up = prior * (p.T @ (_sigmoid(at_p) - 1)) / len(p)
        down = u.T @ _sigmoid(at_u) / len(u) - prior * (p.T @ _sigmoid(at_p)) / len(p)
        negative = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        # A negative estimate means overfitting: step back on that part, as the method prescribes.
        return up + down if negative >= 0 else -down

    w = _descend(gradient, p.shape[1] - 1)
    return Model(w[:-1], float(w[-1]), centre, scale, prior)


def held_out(fold: int = 2, folds: int = 4):
    """Whether a document's labels may not be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def _feature_rows(texts: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                rows = features(part.column(0)).astype(np.float32)
                yield pa.record_batch([pa.array(list(rows), pa.list_(pa.float32()))], ["x"])

    rows = map_batches(texts.select("text"), run, "x array<float>").toArrow().column("x")
    width = 3 * 14
    flat = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    x = np.asarray(flat.flatten(), dtype=float).reshape(-1, width)
    return x[np.lexsort(x.T)]  # what is learned must not depend on the order of files and tasks


def _sampled(rows: DataFrame, limit: int) -> DataFrame:
    """The `limit` ids with the smallest hashes, as a small table."""
    return hashing.smallest_hashes(rows.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", limit)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on the documents that are not held out; None without positives."""
    known = labels.where("quality = 1").where(~held_out())
    pool = docs.select("doc_id").where(~held_out())
    sets = []
    for ids in (known, pool):
        # At most `sample` ids: the bound that makes the broadcast safe.
        chosen = F.broadcast(_sampled(ids, sample))
        sets.append(_feature_rows(hashing.one_text_each(docs.select("doc_id", "text").join(chosen, "doc_id"))))
    return fit(*sets) if len(sets[0]) and len(sets[1]) else None


def _scores(model: Model | None, column: pa.Array) -> np.ndarray:
    return np.full(len(column), 0.5) if model is None else model.score(features(column))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                value = _scores(model, part.column("text"))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("held_out"), pa.array(value),
                     pa.array((value >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    return map_batches(
        docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with a score of at least `threshold`, all columns as they are."""
    if model is None:
        return docs
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            batch = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for part in hashing.slices(batch, str(place)):
                yield part.filter(pa.array(_scores(model, part.column(place)) >= threshold)).rename_columns(names)

    return map_batches(docs, run, docs.schema)
