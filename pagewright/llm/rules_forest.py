"""Quality rules: an isolation forest on rule statistics of documents.

Every document gets the counts that quality rules look at (words, their characters, symbols,
repeated lines, repeated three-word windows).  Documents that fail the base rules, which are plain
limits, go.  Among the others, anomalies are found by isolation: trees split a sample at random
places of random statistics, and a document that few splits separate from the rest is unusual.
One forest looks at all statistics together and one at each alone; a document's score in a forest
of t trees is ``2 ** -(mean path length / expected path length)``.

What score is too unusual is calibrated for each forest from labelled rows: the cut that tells
rows of label 1 from others best, among those that lose at most `LOSS` of the rows of label 1.
The best forest comes first, the others get a cut only for what it leaves.  Without labels of
both kinds no document that passes the base rules goes.

The statistics of all documents are written once (no texts) and everything after works on that
small table.  Trees are grown from at most `TREES` x `ROWS` distinct rows of statistics, those with
the smallest hashes: that is the method's own subsampling, and copies count once however many
there are.  Calibration uses every labelled row, as counts by score; nothing else is sampled.

Null and empty texts have all counts zero and fail the base rules.  Repeated rows are judged
each; a null id is kept and has no label; of several labels of an id each counts for each of its rows;
other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import hashing
from pagewright.session import scratch_folder

#: Base rules: least number of words, largest percentage of words in repeated windows
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
#: Trees of the joint forest, of each statistic's forest, and rows that each tree is grown from
TREES, SINGLE_TREES, ROWS = 100, 25, 256
#: Largest share of rows of label 1 that a forest's cut may lose
LOSS = 0.005
#: Steps between 0 and 1 at which cuts may lie
STEPS = 1000

_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs elsewhere in its text, and whether it does earlier."""
    mixed = hashing.mix(keys + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    anywhere, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:][same]] = True
    anywhere[order[1:][same]] = True
    anywhere[order[:-1][same]] = True
    return anywhere, earlier


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The rule statistics of every text."""
    data, offsets = hashing.buffer_of(column)
    texts = len(offsets) - 1
    begins, ends, text_of = hashing.word_spans(data, offsets)
    words = hashing.word_hashes(data, begins, ends)
    starts = hashing.counts_per_text(text_of, texts)
    code_points = (data & 0xC0) != 0x80
    line_begins, line_ends, line_of = hashing.word_spans(data, offsets, _NEWLINE)
    # Lines with a word: those in which some word begins.
    filled = np.searchsorted(begins, line_ends) > np.searchsorted(begins, line_begins)
    line_begins, line_ends, line_of = line_begins[filled], line_ends[filled], line_of[filled]
    _, known = _repeated(hashing.word_hashes(data, line_begins, line_ends), line_of)
    grams, first = hashing.ngram_hashes(words, text_of, WINDOW)
    twice, _ = _repeated(grams, text_of[first])
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[first[twice] + k] = True
    return {
        "n_words": np.diff(starts),
        "word_chars": _sums(code_points & ~hashing.SPACE[data], offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_lines": np.bincount(line_of, minlength=texts).astype(np.int64),
        "n_dup_lines": np.bincount(line_of[known], minlength=texts).astype(np.int64),
        "n_repeat_words": _sums(covered, starts),
    }


def statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, the counts of every row and whether it fails the base rules."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                found = counts(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), *[pa.array(found[c]) for c in COUNTS]], ["doc_id", *COUNTS])

    rows = docs.select("doc_id", docs[column].alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    return rows.withColumn(
        "base_failed", F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"))


def rates(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """What trees split: characters, symbols and repeated words per word, repeated lines per line."""
    n_words, chars, symbols, lines, dup_lines, repeats = (np.asarray(batch.column(c), dtype=float) for c in COUNTS)
    words = np.maximum(n_words, 1)
    return np.stack([chars / words, symbols / words, dup_lines / np.maximum(lines, 1), repeats / words], axis=1)


STATISTICS = 4


def expected_path(rows: np.ndarray | int) -> np.ndarray:
    """Mean number of splits that single out a row in a random tree over so many rows."""
    m = np.asarray(rows, dtype=float)
    harmonic = np.log(np.maximum(m - 1, 1)) + np.euler_gamma
    return np.where(m > 2, 2 * harmonic - 2 * (m - 1) / np.maximum(m, 1), np.where(m == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as tables: statistic to split (-1: leaf), place, child for smaller values (the other is next), path length."""
    statistic: np.ndarray
    place: np.ndarray
    child: np.ndarray
    length: np.ndarray
    rows: int

    @staticmethod
    def grow(sample: np.ndarray, trees: int, rows: int, usable: list[int], seed: int) -> "Forest":
        """Trees over random subsets of the sample's rows that split only `usable` statistics."""
        draw = np.random.default_rng(seed)
        rows = min(rows, len(sample))
        limit = int(np.ceil(np.log2(max(rows, 2))))
        grown = []
        for _ in range(trees):
            tree = [(-1, 0.0, 0, 0.0)]
            waiting = [(0, sample[draw.choice(len(sample), rows, replace=False)], 0)]
            while waiting:
                node, at, depth = waiting.pop()
                low, high = at.min(0), at.max(0)
                split = [s for s in usable if low[s] < high[s]]
                if depth == limit or not split:
                    tree[node] = (-1, 0.0, node, depth + float(expected_path(len(at))))
                    continue
                s = split[draw.integers(len(split))]
                # Above the smallest value, up to the largest: both sides get rows.
                place = max(draw.uniform(low[s], high[s]), np.nextafter(low[s], high[s]))
                small = at[:, s] < place
                tree[node] = (s, place, len(tree), 0.0)
                waiting += [(len(tree), at[small], depth + 1), (len(tree) + 1, at[~small], depth + 1)]
                tree += [(-1, 0.0, 0, 0.0)] * 2
            grown.append(tree)
        size = max(map(len, grown))
        table = np.zeros((4, trees, size))
        for k, tree in enumerate(grown):
            table[:, k, :len(tree)] = np.array(tree).T
        return Forest(table[0].astype(np.int64), table[1], table[2].astype(np.int64), table[3], rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path) of every row; near 1 for anomalies, 0.5 and less for usual rows."""
        out = np.empty(len(x))
        tree = np.arange(len(self.statistic))
        for a in range(0, len(x), 4096):  # bounds the table of rows and trees
            part = x[a: a + 4096]
            row = np.arange(len(part))[:, None]
            at = np.zeros((len(part), len(tree)), np.int64)
            while True:
                s = self.statistic[tree, at]
                inner = s >= 0
                if not inner.any():
                    break
                larger = part[row, np.maximum(s, 0)] >= self.place[tree, at]
                at = np.where(inner, self.child[tree, at] + larger, at)
            out[a: a + 4096] = self.length[tree, at].mean(1)
        return np.exp2(-out / max(float(expected_path(self.rows)), 1e-9))


@dataclass
class Model:
    """The joint forest and one for each statistic, with the score of each from which a row goes (2: none does)."""
    forests: list[Forest]
    cuts: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.stack([f.score(x) for f in self.forests], axis=1)


def grow(stats: DataFrame, trees: int = TREES, single_trees: int = SINGLE_TREES, rows: int = ROWS) -> list[Forest]:
    """The joint forest, then one per statistic, from a bounded sample of rows that pass the base rules."""
    distinct = stats.where("NOT base_failed").select(*COUNTS).distinct().withColumn("key", F.xxhash64(*COUNTS))
    # At most trees x rows rows of six numbers reach the driver.
    sample = hashing.smallest_hashes(distinct, "key", trees * rows).toArrow()
    x = rates(sample)
    if not len(x):
        return []
    x = x[np.lexsort(x.T)]  # the draws must not depend on the order of partitions
    everything = list(range(STATISTICS))
    return [Forest.grow(x, trees, rows, everything, 1)] + [
        Forest.grow(x, single_trees, rows, [s], 2 + s) for s in everything]


def _with_scores(stats: DataFrame, forests: list[Forest]) -> DataFrame:
    """Adds `scores`, an array with the score in every forest."""
    shared = stats.sparkSession.sparkContext.broadcast(Model(forests, np.zeros(0)))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values = shared.value.scores(rates(batch))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))
            yield pa.record_batch([*batch.columns, lists], [*batch.schema.names, "scores"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    return stats.mapInArrow(run, f"{fields}, scores array<double>")


def best_cut(good: np.ndarray, bad: np.ndarray, all_good: int, all_bad: int, loss: float = LOSS) -> tuple[float, float]:
    """Gain and score of the best cut, from the numbers of good and bad rows by score step.

    The gain is the caught share of all bad rows less the lost share of all good rows.
    """
    lost, caught = np.cumsum(good[::-1])[::-1] / max(all_good, 1), np.cumsum(bad[::-1])[::-1] / max(all_bad, 1)
    gain = np.where(lost <= loss, caught - lost, -1.0)
    # Among equally good cuts the middle one leaves room on both sides.
    best = np.flatnonzero(gain == gain.max())
    return float(gain.max()), float(best[len(best) // 2]) / STEPS


def calibrate(stats: DataFrame, labels: DataFrame, forests: list[Forest], loss: float = LOSS) -> Model:
    """Cuts from the labelled rows that pass the base rules.

    The forest whose cut gains most comes first; each next one is judged by the rows that the
    cuts before it leave, and has no cut if it gains less than `loss` there.
    """
    spark = stats.sparkSession
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).alias("good"))
    labelled = _with_scores(stats.where("NOT base_failed").join(known, "doc_id"), forests)
    folder = scratch_folder(spark, "calibration")
    labelled.select("good", F.expr(f"transform(scores, s -> CAST(least({STEPS}, floor(s * {STEPS})) AS int))").alias("steps")).write.parquet(folder)
    left = spark.read.parquet(folder)
    totals = {good: n for good, n in left.groupBy("good").count().collect()}
    cuts, open_forests = np.full(len(forests), 2.0), set(range(len(forests)))
    while open_forests and len(totals) == 2:
        # At most 2 x forests x steps rows.
        found = left.select("good", F.posexplode("steps").alias("forest", "step")).groupBy("good", "forest", "step").count().collect()
        table = np.zeros((2, len(forests), STEPS + 1))
        for good, forest, step, n in found:
            table[int(good), forest, step] += n
        gain, cut, best = max((*best_cut(table[1, k], table[0, k], totals[True], totals[False], loss), -k) for k in open_forests)
        if gain < loss:
            break
        cuts[-best] = cut
        open_forests.remove(-best)
        left = left.where(F.col("steps")[-best] < round(cut * STEPS))
    return Model(forests, cuts)


def learn(stats: DataFrame, labels: DataFrame) -> Model | None:
    """Forests and cuts; None if no row passes the base rules."""
    forests = grow(stats)
    return calibrate(stats, labels, forests) if forests else None


def judge(docs: DataFrame, labels: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, the score in every forest (null if base_failed) and kept of every row."""
    folder = scratch_folder(docs.sparkSession, "statistics")
    statistics(docs, column).write.parquet(folder)
    stats = docs.sparkSession.read.parquet(folder)
    model = learn(stats, labels)
    if model is None:
        return stats.select("*", F.lit(None).cast("array<double>").alias("scores"), F.lit(False).alias("kept"))
    cuts = F.array(*[F.lit(float(c)) for c in model.cuts])
    unusual = F.exists(F.zip_with("scores", cuts, lambda s, c: s >= c), lambda x: x)
    scored = _with_scores(stats, model.forests)
    return scored.select(
        *stats.columns, F.when(~F.col("base_failed"), F.col("scores")).alias("scores"), (~F.col("base_failed") & ~unusual).alias("kept"))
