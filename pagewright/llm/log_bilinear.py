"""Log-probabilities of whole texts under a log-bilinear neural language model.

The model predicts units: the most frequent tokens, and for all others groups by their last three
bytes.  For each of the two places before a token there is a log-bilinear model: the score of a
unit is the product of its vector with that of the unit at that place, plus a bias.  The vectors are
trained in numpy with noise-contrastive estimation on the counts of all pairs of units in the
training texts: every step takes the expectation over all cells of the table of pairs and over all
noise units, so nothing is drawn and every pair counts in every step.  Batched matrix products turn scores into normalised log-probabilities of every
unit after every unit; the two models and the units' frequencies are mixed with weights from
expectation maximisation over all training places, which are summed where they are into `GRID` x
`GRID` cells by the shares of the three.  A token of a group has the group's chance times (c + 1) / (the sum of
that over the group's tokens, plus 1 for tokens never seen), c being its count in training.

What comes from the texts follows the texts: token counts, pair counts, each token's own count and
the shares for the mixing weights cover all of them.  Counts are combined before shuffles.  What tasks and driver hold is bounded:
`UNITS` and `GROUPS` (vectors, pair counts), `GRID` and the `KNOWN` most frequent tokens with their
counts.  The counts of other tokens are joined: more than
`KNOWN` tokens are at least about as frequent, so no key of that join is hot.

Tokens: A to Z lower-cased, words are runs of bytes other than white space, and every text ends
with one end token, also a null or empty one.  Without training texts all counts are zero and the
chances uniform.  Repeated rows and ids are texts of their own; a null doc_id is a training text.
Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import hashing
from pagewright.llm.quality import held_out
from pagewright.session import scratch_folder

UNITS, GROUPS, KNOWN, GRID = 1_024, 384, 262_144, 256
ALL = UNITS + GROUPS
WIDTH, STEPS, NOISE, RATE = 32, 500, 64, 0.1
#: Texts whose id falls into this fold are scored, not learned from
FOLD, FOLDS = 2, 7

END = int(hashing.mix(np.array([0x0E4D], np.uint64))[0])


@dataclass
class Stream:
    """The tokens of all texts of a batch, end tokens included."""
    hashes: np.ndarray
    group: np.ndarray
    owner: np.ndarray
    texts: int

    @staticmethod
    def of(column: pa.Array) -> "Stream":
        data, offsets = hashing.buffer_of(column)
        data, texts = hashing.ASCII_LOWER[data], len(offsets) - 1
        begins, ends, text_of = hashing.word_spans(data, offsets)
        words = hashing.word_hashes(data, begins, ends)
        tail = np.zeros(len(words), np.uint64)
        for back in (1, 2, 3):
            at = ends - back
            tail = tail * np.uint64(257) + np.where(at >= begins, data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        starts = hashing.counts_per_text(text_of, texts)
        total = len(words) + texts
        hashes, group = np.full(total, END, np.uint64), np.zeros(total, np.int32)
        place = np.arange(len(words)) + text_of
        hashes[place], group[place] = words, (hashing.mix(tail) % np.uint64(GROUPS)).astype(np.int32)
        owner = np.repeat(np.arange(texts), np.diff(starts) + 1)
        return Stream(hashes, group, owner, texts)

    def units(self, names: np.ndarray) -> np.ndarray:
        """Unit of every token: its number among the sorted `names`, or its group after them."""
        at = np.searchsorted(names, self.hashes)
        at[at == len(names)] = 0
        return np.where(names[at] == self.hashes, at, UNITS + self.group) if len(names) else UNITS + self.group

    def before(self, units: np.ndarray, back: int, end: int) -> np.ndarray:
        """Unit `back` places earlier; before a text there are end tokens."""
        out = np.full(len(units), end, units.dtype)
        same = self.owner[back:] == self.owner[:-back]
        out[back:][same] = units[:-back][same]
        return out


@dataclass
class Model:
    """Vectors and biases per place, chances without context, mixing weights."""
    names: np.ndarray
    left: list[np.ndarray]
    right: list[np.ndarray]
    bias: list[np.ndarray]
    alone: np.ndarray
    mixing: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """Chance of every unit after every unit, for each place, times its mixing weight."""
        return [w * softmax_rows(a @ b.T + c) for w, a, b, c in zip(self.mixing[1:], self.left, self.right, self.bias)]


def softmax_rows(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(1, keepdims=True))
    return scores / scores.sum(1, keepdims=True)


def contrast(first: np.ndarray, second: np.ndarray, weight: np.ndarray, alone: np.ndarray, steps: int = STEPS, seed: int = 0):
    """Noise-contrastive estimation on weighted pairs (unit before, unit).

    Each step tells all pairs from `NOISE` times as many noise units, both by their expectation:
    scores and gradients are matrix products over the whole table.
    """
    size, rng = len(alone), np.random.default_rng(seed)
    left = rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32)
    right = rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32)
    log_alone = np.log(alone).astype(np.float32)
    bias = log_alone.copy()
    if not len(first):
        return left * 0, right * 0, bias
    share = np.bincount(first * size + second, weight / weight.sum(), size * size).reshape(size, size)
    before = share.sum(1)
    # Units that nothing follows have no cells and keep their vectors.
    there = np.flatnonzero(before)
    share = share[there].astype(np.float32)
    noise = before[there, None].astype(np.float32) * (NOISE * alone).astype(np.float32)
    both = share + noise
    offset = bias - np.float32(np.log(NOISE)) - log_alone
    sums = [np.full_like(x, 1e-2) for x in (left, right, bias)]
    for step in range(steps):
        rows = left[there]
        # Chance that a unit is real and not noise, and the slope of the likelihood by its score.
        slope = rows @ right.T
        slope += offset
        np.clip(slope, -30, 30, out=slope)
        np.negative(slope, out=slope)
        np.exp(slope, out=slope)
        slope += 1
        np.divide(both, slope, out=slope)
        np.subtract(share, slope, out=slope)
        grads = [np.zeros_like(left), slope.T @ rows, slope.sum(0)]
        grads[0][there] = slope @ right
        rate = RATE * (1 - step / steps) + 0.005
        for x, g, s in zip((left, right, bias), grads, sums):
            g = g * 64
            s += g * g
            x += (rate * g / np.sqrt(s)).astype(np.float32)
        offset = bias - np.float32(np.log(NOISE)) - log_alone
    return left, right, bias


def mix_weights(chances: np.ndarray, rounds: int = 30, n: np.ndarray | None = None) -> np.ndarray:
    """Weights of the mixture with the largest likelihood; a row of chances for each place, or for each n places."""
    weights = np.full(chances.shape[1], 1 / chances.shape[1])
    n = np.ones(len(chances)) if n is None else n
    for _ in range(rounds if len(chances) else 0):
        share = chances * weights
        weights = n @ (share / share.sum(1, keepdims=True)) / n.sum()
    weights = np.maximum(weights, 0.01)
    return weights / weights.sum()


def _parts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from hashing.slices(batch, "text")


def token_counts(training: DataFrame) -> DataFrame:
    """hash, group and n of every token of the texts."""
    def run(batches: Iterator[pa.RecordBatch]):
        for part in _parts(batches):
            stream = Stream.of(part.column("text"))
            names, first, n = np.unique(stream.hashes, return_index=True, return_counts=True)
            yield pa.record_batch([pa.array(names.astype(np.int64)), pa.array(stream.group[first]), pa.array(n)], ["hash", "group", "n"])

    return training.select("text").mapInArrow(run, "hash long, group int, n long").groupBy("hash").agg(
        F.min("group").alias("group"), F.sum("n").alias("n"))


def pair_counts(training: DataFrame, names: np.ndarray) -> DataFrame:
    """place (1, 2), cell (unit before * ALL + unit) and n."""
    shared = training.sparkSession.sparkContext.broadcast(names)

    def rows(place, cells, n):
        return pa.record_batch([pa.array(np.full(len(cells), place, np.int32)), pa.array(cells), pa.array(n)], ["place", "cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]):
        names = shared.value
        end = int(np.searchsorted(names, np.uint64(END)))
        sums = [np.zeros(ALL * ALL, np.int64), np.zeros(ALL * ALL, np.int64)]
        for part in _parts(batches):
            stream = Stream.of(part.column("text"))
            units = stream.units(names).astype(np.int64)
            one, two = stream.before(units, 1, end), stream.before(units, 2, end)
            for total, before in zip(sums, (one, two)):
                total += np.bincount(before * ALL + units, minlength=ALL * ALL)
        for place, total in enumerate(sums, 1):
            cells = np.flatnonzero(total)
            for at in range(0, len(cells), 100_000):
                part = cells[at: at + 100_000]
                yield rows(place, part, total[part])

    return training.select("text").mapInArrow(run, "place int, cell long, n long").groupBy("place", "cell").agg(F.sum("n").alias("n"))


def mixture_shares(training: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the three chances (alone, one back, two back) of all training places, and how many have them.

    The best weights depend on each place's shares alone.  Places are summed by cell of a grid over
    two of the shares, with the mean of each cell, so what tasks give is bounded.
    """
    shared = training.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        one, two = model.tables()
        zero = model.mixing[0] * model.alone
        end = int(np.searchsorted(model.names, np.uint64(END)))
        sums = np.zeros((3, GRID * GRID))
        for part in _parts(batches):
            stream = Stream.of(part.column("text"))
            units = stream.units(model.names)
            a, b = one[stream.before(units, 1, end), units], two[stream.before(units, 2, end), units]
            whole = a + b + zero[units]
            a, b = a / whole, b / whole
            cell = np.minimum((a * GRID).astype(np.int64), GRID - 1) * GRID + np.minimum((b * GRID).astype(np.int64), GRID - 1)
            for total, x in zip(sums, (None, a, b)):
                total += np.bincount(cell, x, GRID * GRID)
        cells = np.flatnonzero(sums[0])
        yield pa.record_batch([pa.array(cells), *map(pa.array, sums[:, cells])], ["cell", "n", "a", "b"])

    # At most GRID * GRID rows.
    got = training.select("text").mapInArrow(run, "cell long, n double, a double, b double").groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in "nab"]).toArrow()
    order = np.argsort(got.column("cell").to_numpy())
    n, a, b = (got.column(c).to_numpy()[order] for c in "nab")
    a, b = a / n, b / n
    return np.stack([np.maximum(1 - a - b, 0), a, b], 1), n


def _written(frame: DataFrame, name: str) -> DataFrame:
    folder = scratch_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def fit(training: DataFrame, names: np.ndarray, alone: np.ndarray) -> Model:
    """Train on the pair counts of all training texts."""
    pairs = _written(pair_counts(training, names), "unit-pairs")
    left, right, bias = [], [], []
    for place in (1, 2):
        # At most ALL * ALL rows.
        got = pairs.where(F.col("place") == place).select("cell", "n").toArrow()
        cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy().astype(float)
        order = np.argsort(cell)
        a, b, c = contrast(cell[order] // ALL, cell[order] % ALL, n[order], alone, seed=place)
        left.append(a)
        right.append(b)
        bias.append(c)
    model = Model(names, left, right, bias, alone, np.array([1.0, 1.0, 1.0]))
    shares, n = mixture_shares(training, model)
    model.mixing = mix_weights(shares, n=n)
    return model


def _least_count(counts: DataFrame) -> int:
    """The smallest count that at most KNOWN tokens reach, up to steps of a 32nd of an octave.

    Counts are grouped by such steps (at most 2 048 groups), so no task sorts all tokens.
    """
    step = "CAST(floor(log2(n) * 32) AS int)"
    sizes = counts.selectExpr(f"{step} AS step", "n").groupBy("step").agg(
        F.count("*").alias("tokens"), F.min("n").alias("least")).collect()
    least, total = 1 << 62, 0
    for row in sorted(sizes, reverse=True):
        total += row["tokens"]
        if total > KNOWN:
            break
        least = row["least"]
    return least


def score(docs: DataFrame, fold: int = FOLD, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", held_out(fold, folds).alias("held_out"), "text")
    training = texts.where("NOT held_out")
    counts = _written(token_counts(training), "token-counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Up to KNOWN most frequent tokens: a table of a few megabytes, whatever the input.
    # The end token, which every text has, is always among them.
    end = int(np.uint64(END).astype(np.int64))
    top = counts.where((F.col("n") >= _least_count(counts)) | (F.col("hash") == end)).toArrow()
    order = np.lexsort((top.column("hash").to_numpy(), -top.column("n").to_numpy()))
    known = top.column("hash").to_numpy()[order].astype(np.uint64)
    known_n, known_group = top.column("n").to_numpy()[order], top.column("group").to_numpy()[order]
    chosen = np.zeros(len(known), bool)
    chosen[: UNITS - 1] = True
    chosen |= known == np.uint64(END)
    names = np.sort(np.unique(np.append(known[chosen][:UNITS], np.uint64(END)))[:UNITS])
    names = names if np.uint64(END) in names else np.sort(np.append(names[:-1], np.uint64(END)))
    is_unit = np.isin(known, names)
    # Frequencies of units and the mass of each group.
    per_group = counts.groupBy("group").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    group_n, group_kinds = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in per_group:
        group_n[r["group"]], group_kinds[r["group"]] = r["n"], r["kinds"]
    group_n -= np.bincount(known_group[is_unit], known_n[is_unit], GROUPS)
    group_kinds -= np.bincount(known_group[is_unit], minlength=GROUPS)
    unit_n = np.zeros(ALL)
    unit_n[np.searchsorted(names, known[is_unit])] = known_n[is_unit]
    unit_n[UNITS:] = group_n
    # Places that no token has (fewer tokens than units) get no chance at all.
    real = np.ones(ALL, bool)
    real[len(names): UNITS] = False
    alone = np.where(real, unit_n + 1, 1e-9)
    alone /= alone.sum()
    model = fit(training, names, alone)
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast(
        (model, known[order], np.log10(known_n[order] + 1.0), np.log10(group_n + group_kinds + 1)))
    schema = ("uid long, doc_id long, held_out boolean, n_tokens long, known long, counts double, model double, "
              "rare array<struct<hash: long, tf: int>>")

    def run(batches: Iterator[pa.RecordBatch]):
        model, known, known_log, group_log = shared.value
        one, two = model.tables()
        zero = model.mixing[0] * model.alone
        end = int(np.searchsorted(model.names, np.uint64(END)))
        uid = TaskContext.get().partitionId() << 33
        for part in _parts(batches):
            stream = Stream.of(part.column("text"))
            units = stream.units(model.names)
            chance = one[stream.before(units, 1, end), units] + two[stream.before(units, 2, end), units] + zero[units]
            value = np.log10(chance)
            if len(known):
                at = np.searchsorted(known, stream.hashes)
                at[at == len(known)] = 0
                found = known[at] == stream.hashes
                log_count = np.where(found, known_log[at], 0)
            else:
                found, log_count = np.zeros(len(units), bool), np.zeros(len(units))
            grouped = units >= UNITS
            value[grouped] += log_count[grouped] - group_log[stream.group[grouped]]

            def total(x):
                return pa.array(np.bincount(stream.owner, x, stream.texts))

            other = np.flatnonzero(~found)
            by = np.lexsort((stream.hashes[other], stream.owner[other]))
            owner, hashes = stream.owner[other][by], stream.hashes[other][by]
            fresh = np.ones(len(owner), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
            first = np.flatnonzero(fresh)
            tf = np.diff(np.append(first, len(owner))).astype(np.int32)
            offsets = hashing.counts_per_text(owner[first], stream.texts).astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(hashes[first].astype(np.int64)), pa.array(tf)], ["hash", "tf"])
            n = part.num_rows
            yield pa.record_batch(
                [pa.array(np.arange(uid, uid + n)), part.column("doc_id"), part.column("held_out"),
                 pa.array(np.bincount(stream.owner, minlength=n)), pa.array(np.bincount(stream.owner, found, n).astype(np.int64)),
                 total(log_count), total(value), pa.ListArray.from_arrays(pa.array(offsets), rare)],
                ["uid", "doc_id", "held_out", "n_tokens", "known", "counts", "model", "rare"])
            uid += n

    scored = _written(texts.mapInArrow(run, schema), "scored")
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.hash").alias("hash"), F.col("r.tf").alias("tf"))
    found = rare.join(counts.select("hash", "n"), "hash").groupBy("uid").agg(
        F.sum(F.expr("tf * log10(n + 1D)")).alias("more"), F.sum("tf").alias("more_known"))
    per_token = float(np.log10(tokens + kinds + 1))
    return scored.drop("rare").join(found, "uid", "left").na.fill(0, ["more", "more_known"]).select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("counts") + F.col("more") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("model") + F.col("more")).alias("score"))
