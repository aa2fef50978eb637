"""Periodic runs of words: menus, tables and loops that repeat at one distance.

A run is a stretch of words with smallest period q (words q apart are equal) and at least
`LEAST` words and `TIMES` periods that neither neighbour extends.  Words after a run's first
period are what collapsing a text drops.

`Diagonals` reads a text word by word.  For each word, its earlier occurrences increment the match
length of their lag (the diagonal they lie on), and a lag whose match ends is emitted at once if it
was long enough.  Which earlier occurrences can matter is decided by their context: a run with
smallest period q in (L/2, L] matches more than L words in a row, and on it the nearest earlier
occurrence of the last L words is exactly q words back (a nearer one would make the period
smaller).  So one lag is active for each L = 16, 32, 64, ..., and a text of n words costs
n log n steps even if all its words are the same.  Nothing is left out: the tests compare with
the same search over all earlier occurrences and with the definition.

Words are `[^\\x20\\x09-\\x0D]+`, compared by 64-bit hashes.  Texts in which no 16 words come
twice, found for whole batches at once, can have no run and are not walked.  There is no shuffle
and a task holds one run of at most a few megabytes of text (or one longer text).

Null and empty texts have no words and no runs; their collapsed text is empty.  Repeated rows
are searched each; a null id is kept; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm import hashing

#: Least number of words and of periods of a run
LEAST, TIMES = 24, 3

Run = tuple[int, int, int]


def least_context(least: int = LEAST, times: int = TIMES) -> int:
    """Words that match in a row on every run, whatever its period."""
    if times < 3:
        raise ValueError("a run has at least three periods")
    return min(max(least - q, (times - 1) * q) for q in range(1, max(least, 1) + 1))


class _Lag:
    """The active diagonal among those with contexts of one size."""

    def __init__(self, context: int, above: int):
        self.context, self.above = context, above
        self.seen: dict[int, int] = {}
        self.lag = self.length = 0


class Diagonals:
    """Online search: push the contexts that end at each word, collect runs as they end."""

    def __init__(self, contexts: list[int], least: int = LEAST, times: int = TIMES):
        self.least, self.times, self.at = least, times, 0
        self.lags = [_Lag(c, contexts[k - 1] if k else 0) for k, c in enumerate(contexts)]

    def push(self, ending: Iterable[int | None]) -> Iterator[Run]:
        """Reads a word, given by the hashes of the last words of each context's size."""
        at = self.at
        for kind, value in zip(self.lags, ending):
            lag = 0
            if value is not None:
                lag = at - kind.seen.get(value, at)
                kind.seen[value] = at
            if lag == kind.lag:
                kind.length += 1
                continue
            if kind.lag:
                yield from self._emit(kind)
            kind.lag, kind.length = lag, kind.context
        self.at = at + 1

    def end(self) -> Iterator[Run]:
        for kind in self.lags:
            if kind.lag:
                yield from self._emit(kind)

    def _emit(self, kind: _Lag) -> Iterator[Run]:
        lag, length = kind.lag, kind.length
        if kind.above < lag <= kind.context and length >= max(self.least - lag, (self.times - 1) * lag):
            yield self.at - length - lag, length + lag, lag


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of all runs of a text, by start, then period, from its words' hashes."""
    n, context = len(words), least_context(least, times)
    contexts, ending, hashes = [], [], words
    size = 1
    while size < context:  # context sizes below the smallest are joined from parts
        step = min(size, context - size)
        hashes = _longer(hashes, step)
        size += step
    while 3 * size < 2 * n or not contexts:
        contexts.append(size)
        ending.append([None] * min(size - 1, n) + hashes.tolist())
        hashes = _longer(hashes, size)
        size *= 2
    search, found = Diagonals(contexts, least, times), []
    for values in zip(*ending):
        found.extend(search.push(values))
    found.extend(search.end())
    return sorted(found, key=lambda r: (r[0], r[2]))


def _longer(hashes: np.ndarray, more: int) -> np.ndarray:
    """Hashes of stretches that are `more` words longer, each put together from two overlapping or adjacent ones."""
    return hashing.mix(hashes[:-more] * np.uint64(0x9E3779B97F4A7C15) + hashing.mix(hashes[more:])) if len(hashes) > more else hashes[:0]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the most periods; ties by start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def texts_to_search(words: np.ndarray, text_of: np.ndarray, context: int) -> np.ndarray:
    """Numbers of the texts in which some `context` words come twice."""
    grams, first = hashing.ngram_hashes(words, text_of, context)
    owner = text_of[first]
    keys = hashing.mix(grams + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    return np.unique(owner[order[1:]][keys[order[1:]] == keys[order[:-1]]])


def search(column: pa.Array, least: int = LEAST, times: int = TIMES):
    """Number of words, runs and collapsed text of every text of a column."""
    data, offsets = hashing.buffer_of(column)
    begins, ends, text_of = hashing.word_spans(data, offsets)
    words, texts = hashing.word_hashes(data, begins, ends), len(offsets) - 1
    starts = hashing.counts_per_text(text_of, texts)
    runs: dict[int, list[Run]] = {}
    kept = np.ones(len(words), bool)
    for t in texts_to_search(words, text_of, least_context(least, times)).tolist():
        if found := runs_of(words[starts[t]: starts[t + 1]], least, times):
            runs[t] = found
            for start, length, period in found:
                kept[starts[t] + start + period: starts[t] + start + length] = False
    # Kept words with the gap after each, but for the last kept one of a text.
    at = np.flatnonzero(kept)
    last = np.ones(len(at), bool)
    last[:-1] = text_of[at[1:]] != text_of[at[:-1]]
    edges = np.zeros(len(data) + 1, np.int8)
    edges[begins[at]] += 1
    edges[ends[at]] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    gaps = ends[at[~last]]
    inside[gaps] = True
    spaced = data.copy()
    spaced[gaps] = 0x20
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=sums[1:])
    collapsed = pa.Array.from_buffers(
        pa.large_string(), texts, [None, pa.py_buffer(sums[offsets]), pa.py_buffer(spaced[inside])])
    return np.diff(starts), [runs.get(t, []) for t in range(texts)], collapsed


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, column: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), the strongest run and the collapsed text of every row."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                sizes, runs, collapsed = search(part.column("text"), least, times)
                as_structs = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
                best = [dict(zip(("start", "length", "period"), b)) if (b := strongest(found)) else None for found in runs]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(sizes), pa.array(as_structs, pa.list_(RUN)), pa.array(best, RUN), collapsed.cast(pa.string())],
                    ["doc_id", "n_words", "runs", "strongest", "collapsed"])

    kind = "struct<start: long, length: long, period: long>"
    return docs.select("doc_id", docs[column].alias("text")).mapInArrow(
        run, f"doc_id long, n_words long, runs array<{kind}>, strongest {kind}, collapsed string")
