"""Token streams of whole Arrow batches as numpy arrays.

A batch of texts is one byte buffer with offsets, so words, their 64-bit hashes and n-grams of
all texts come from a few vector operations instead of a loop over words.  Memory is bounded by
`slices`, which cuts a batch into runs of rows of at most a few megabytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
BITMAP_BITS = 1 << 26

#: White space of the token pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything in ASCII that is neither letter nor digit
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_BASE = 0xD6E8FEB86659FD93
_BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, _BLOCK + (1 << 16)), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `limit` bytes of text; a longer text is a run of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; a null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Begin, end and text number of every maximal run of bytes that are not in `gap`."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    blank = gap[data]
    opens, closes = np.empty(n, bool), np.empty(n, bool)
    opens[0], closes[-1] = True, True
    opens[1:], closes[:-1] = blank[:-1], blank[1:]
    opens[offsets[:-1][offsets[:-1] < n]] = True
    closes[offsets[1:][offsets[1:] > 0] - 1] = True
    begins, ends = np.flatnonzero(opens & ~blank), np.flatnonzero(closes & ~blank) + 1
    return begins, ends, np.searchsorted(offsets, begins, "right") - 1


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, taken in blocks of about a megabyte."""
    out = np.empty(len(begins), np.uint64)
    at = 0
    while at < len(begins):
        first = begins[at]
        stop = max(at + 1, int(np.searchsorted(begins, first + _BLOCK)))
        size = int(ends[stop - 1] - first)
        power = _power(_BASE, size + 1, "power")
        inverse = _power(pow(_BASE, -1, 1 << 64), size + 1, "inverse")
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data[first: first + size]] * power[:size], out=sums[1:])
        b, e = begins[at:stop] - first, ends[at:stop] - first
        out[at:stop] = (sums[e] - sums[b]) * inverse[b] + (e - b).astype(np.uint64) * np.uint64(_STEP)
        at = stop
    return mix(out)


def counts_per_text(text_of: np.ndarray, texts: int) -> np.ndarray:
    """Where the rows of each text begin, from the text number of every row."""
    return np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=texts))]).astype(np.int64)


def ngram_hashes(words: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row and the number of the first; none for texts with fewer words."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(words) - n + 1
    out, factor = np.zeros(size, np.uint64), 1
    for k in range(n):
        out += words[k: k + size] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    first = np.flatnonzero(text_of[:size] == text_of[n - 1:])
    return mix(out[first]), first


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct word n-grams of every text, one after the other, and where each begins.

    Words are lower-cased and separated by white space.  A text with fewer than n words has one
    n-gram, all its words; a text without words has none.
    """
    data, offsets = buffer_of(lower(column))
    begins, ends, text_of = word_spans(data, offsets)
    words, texts = word_hashes(data, begins, ends), len(offsets) - 1
    grams, first = ngram_hashes(words, text_of, n)
    owner = text_of[first]
    starts = counts_per_text(text_of, texts)
    sizes = np.diff(starts)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        value, factor = np.zeros(len(short), np.uint64), 1
        for k in range(n - 1):
            there = sizes[short] > k
            value[there] += words[starts[short[there]] + k] * np.uint64(factor)
            factor = factor * _BASE % (1 << 64)
        grams = np.concatenate([grams, mix(value + sizes[short].astype(np.uint64) * np.uint64(_STEP))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    bounds = counts_per_text(owner, texts)
    for a, b in zip(bounds[:-1], bounds[1:]):
        grams[a:b].sort()
    if len(grams):
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[fresh], owner[fresh]
    return grams, counts_per_text(owner, texts)


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each 64-bit key modulo `BITMAP_BITS`: 8 MB, however many keys there are.

    It only saves work: rows whose bit is not set cannot match, the others are joined exactly.
    """
    rows = (
        keys.selectExpr(f"{column} & {BITMAP_BITS - 1} AS place")
        .groupBy(F.expr("place DIV 32768").alias("part"))
        .agg(F.bitmap_construct_agg(F.expr("place % 32768")).alias("bits")).collect())
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    for part, bits in rows:
        bitmap[part * 4096: part * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return bitmap


def smallest_hashes(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The `limit` rows with the smallest hashes of their key, ties by key.

    Rows that can't be among them are dropped where they are, so that what is sorted in the end
    does not grow with the number of partitions.
    """
    total = rows.count()
    if total > 4 * limit:
        # Twice the share that is wanted: fewer rows than the limit would be a miss of many deviations.
        rows = rows.where(F.xxhash64(key) < int(-(1 << 63) + (1 << 64) * (2 * limit / total)))
    return rows.orderBy(F.xxhash64(key), key).limit(limit)


def one_text_each(rows: DataFrame) -> DataFrame:
    """Of the rows of every doc_id the one whose text has the smallest hash: so a sample of ids is one of rows.

    Tasks keep one row per id before anything moves; other columns must be those of the id.
    """
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    return rows.groupBy("doc_id", *rest).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select(
        "doc_id", F.col("least.text").alias("text"), *rest)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
