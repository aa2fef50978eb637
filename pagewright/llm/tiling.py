"""Benchmark decontamination by greedy string tiling.

A document is contaminated if tiles, long runs of words that it shares with a benchmark item,
cover at least `COVERAGE` of the item's words and `LEAST_WORDS` words (or the whole item, if it is
shorter), so that a part of an item is found and a common phrase is not; or if one tile has
`LONG_TILE` words, however long the item is.  Longest matches are marked first and marked words
are not used again, so a passage whose sentences come in another order is found as well.

Running Karp-Rabin matching: hashes of `SEED` words in a row are joined with those of the items;
seeds next to each other on one diagonal make a longer match.  The items' seeds reach the tasks
as a hash table of bounded size: a benchmark with more than `CHUNK` seeds is cut into chunks of
items, and the documents are read once per chunk.  Documents are neither shuffled nor grouped, so
a passage that many documents share costs what its documents cost.  Equal sets of
matches, as passages give that many documents and items share, are tiled once.

Words are lower-cased runs of letters and digits.  Items with fewer than `SEED` words match
nothing.  Null and empty texts, on either side, match nothing.  Items with equal texts are one, with
the smallest of their ids.  Items without id take part; a document that holds one is contaminated and its item_id is null.
Among equal coverages the smallest item_id is reported, null last.  Repeated rows are judged each; other columns take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import hashing
from pagewright.session import map_batches, scratch_folder

SEED, COVERAGE = 5, 0.3
#: Words that must be covered at least, or the whole item if it is shorter
LEAST_WORDS = 8
#: Words of a tile that count whatever the length of the item
LONG_TILE = 50
#: Bound of the seeds that tasks hold at a time, and of the matches that are looked at together (or one text's)
CHUNK, HITS = 1_000_000, 1_000_000
_UNNAMED = np.iinfo(np.int64).max


def _seeds(column: pa.Array):
    """Hash, text number and place of every seed, and the number of words of every text."""
    data, offsets = hashing.buffer_of(hashing.lower(column))
    begins, ends, text_of = hashing.word_spans(data, offsets, hashing.NOT_ALNUM)
    words = hashing.word_hashes(data, begins, ends)
    starts = hashing.counts_per_text(text_of, len(offsets) - 1)
    grams, first = hashing.ngram_hashes(words, text_of, SEED)
    owner = text_of[first]
    return grams, owner, first - starts[owner], np.diff(starts)


def _seed_rows(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                grams, owner, place, words = _seeds(part.column("text"))
                yield pa.record_batch(
                    [part.column("item").take(pa.array(owner)), part.column("item_id").take(pa.array(owner)),
                     pa.array(grams.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(words[owner].astype(np.int32))],
                    ["item", "item_id", "seed", "place", "words"])

    # One row per text, under a key of its own: ids may be null or name several texts.
    texts = items.groupBy("text").agg(F.min("item_id").alias("item_id")).select(F.xxhash64("text").alias("item"), "item_id", "text")
    return map_batches(texts, run, "item long, item_id long, seed long, place int, words int")


@dataclass
class Table:
    """The seeds of a chunk of items, sorted by hash."""
    seed: np.ndarray
    item: np.ndarray
    #: Ids for reports; `_UNNAMED` for null
    name: np.ndarray
    place: np.ndarray
    words: np.ndarray
    bitmap: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> "Table":
        seed = rows.column("seed").to_numpy().astype(np.uint64)
        item, place, words = (rows.column(c).to_numpy() for c in ("item", "place", "words"))
        name = pc.fill_null(rows.column("item_id"), _UNNAMED).to_numpy()
        order = np.lexsort((place, item, seed))
        bitmap = np.zeros(hashing.BITMAP_BITS // 8, np.uint8)
        at = (seed & np.uint64(hashing.BITMAP_BITS - 1)).astype(np.int64)
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return Table(seed[order], item[order], name[order], place[order], words[order], bitmap)


def tables(benchmark: DataFrame, chunk: int = CHUNK) -> Iterator[Table]:
    """The benchmark's seeds in chunks of whole items of about `chunk` seeds."""
    seeds = _seed_rows(benchmark).distinct()
    parts = max(1, -(-seeds.count() // chunk))
    for part in range(parts):
        yield Table.of(seeds.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toArrow())


def tile(pairs: list[tuple[int, int]], seed: int = SEED) -> tuple[int, int]:
    """Words of the item that greedy tiling marks, and of its longest tile; pairs are (text place, item place) of equal seeds."""
    runs, by_diagonal = [], {}
    for t, i in pairs:
        by_diagonal.setdefault(t - i, []).append(i)
    for diagonal, places in by_diagonal.items():
        places = sorted(set(places))
        begin = last = places[0]
        for place in [*places[1:], None]:
            if place is None or place != last + 1:
                runs.append((-(last - begin + seed), begin, begin + diagonal))
                begin = place
            last = place
    heapq.heapify(runs)
    longest = -runs[0][0] if runs else 0
    text_marks, item_marks = set(), set()
    while runs:
        length, i, t = heapq.heappop(runs)
        free = [k for k in range(-length) if i + k not in item_marks and t + k not in text_marks]
        if len(free) == -length:
            item_marks.update(range(i, i - length))
            text_marks.update(range(t, t - length))
            continue
        # What is left of a partly marked match competes again with its new length.
        begin = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - begin >= seed:
                    heapq.heappush(runs, (begin - k, i + free[begin], t + free[begin]))
                begin = k
    return len(item_marks), longest


def matches(column: pa.Array, table: Table, coverage: float = COVERAGE) -> dict[int, tuple[float, int]]:
    """Coverage and item of the best covered item, for each text number with one that counts."""
    grams, owner, place, _ = _seeds(column)
    near = np.flatnonzero(hashing.in_bitmap(table.bitmap, grams))
    low = np.searchsorted(table.seed, grams[near], "left")
    many = np.searchsorted(table.seed, grams[near], "right") - low
    near, low, many = near[many > 0], low[many > 0], many[many > 0]
    best: dict[int, tuple[float, int]] = {}
    known: dict[bytes, tuple[int, int]] = {}
    # Runs of whole texts with a bounded number of matches.
    starts = np.append(np.flatnonzero(np.diff(owner[near], prepend=-1)), len(near))
    sums = np.concatenate([[0], np.cumsum(many)])
    k = 0
    while k < len(starts) - 1:
        stop = max(k + 1, int(np.searchsorted(sums[starts], sums[starts[k]] + HITS, "right")) - 1)
        part = slice(starts[k], starts[stop])
        _match(owner, place, near[part], low[part], many[part], table, coverage, best, known)
        k = stop
    return best


def _match(owner, place, near, low, many, table: Table, coverage: float, best: dict[int, tuple[float, int]],
           known: dict[bytes, tuple[int, int]]) -> None:
    """Adds the best items of some texts, given by their seeds and the entries of the table that these match."""
    hit = np.repeat(near, many)
    entry = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    text, item = owner[hit], table.item[entry]
    at_text, at_item = place[hit], table.place[entry]
    order = np.lexsort((at_item, item, text))
    text, item, at_text, at_item, entry = (x[order] for x in (text, item, at_text, at_item, entry))
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], len(text))
    words, name = table.words[entry[begins]], table.name[entry[begins]]
    # Distinct seeds of the item that occur: each covers SEED words at most.
    step = fresh.copy()
    step[1:] |= at_item[1:] != at_item[:-1]
    distinct = np.add.reduceat(step.astype(np.int64), begins)
    worth = (distinct * SEED >= coverage * words) | (distinct > LONG_TILE - SEED)
    for a, b, n, i, t in zip(begins[worth].tolist(), ends[worth].tolist(), words[worth].tolist(), name[worth].tolist(), text[begins[worth]].tolist()):
        # A shift on either side changes no tile, so matches of one passage in many places look the same.
        pairs = np.stack([at_text[a:b] - at_text[a:b].min(), at_item[a:b] - at_item[a]], axis=1)
        key = pairs.tobytes()
        found = known.get(key)
        if found is None:
            if len(known) >= 10_000:
                known.clear()
            found = known[key] = tile(pairs.tolist())
        covered, longest = found
        share = covered / n
        if (share >= coverage and covered >= min(LEAST_WORDS, n)) or longest >= LONG_TILE:
            old = best.get(t)
            if old is None or (-share, i) < (-old[0], old[1]):
                best[t] = (share, i)


def _between(frame: DataFrame, name: str) -> DataFrame:
    folder = scratch_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, contaminated, item_id and coverage of the best covered item of every document."""
    schema = "doc_id long, text string, item_id long, coverage double"
    frame = docs.selectExpr("doc_id", "text", "CAST(NULL AS long) AS item_id", "0D AS coverage")
    for number, table in enumerate(tables(benchmark, chunk)):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            for batch in batches:
                for part in hashing.slices(batch, "text"):
                    found = matches(part.column("text"), shared.value, coverage)
                    item, share = part.column("item_id").to_pylist(), part.column("coverage").to_pylist()
                    for row, (value, name) in found.items():
                        if value > share[row] or value == share[row] and name < (_UNNAMED if item[row] is None else item[row]):
                            item[row], share[row] = None if name == _UNNAMED else name, value
                    yield pa.record_batch(
                        [part.column("doc_id"), part.column("text"), pa.array(item, pa.int64()), pa.array(share, pa.float64())],
                        ["doc_id", "text", "item_id", "coverage"])

        if number:
            frame = _between(frame, "contamination")
        frame = map_batches(frame, run, schema)
    # A coverage is only kept for items that count.
    return frame.select("doc_id", (F.col("coverage") > 0).alias("contaminated"), "item_id", "coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, chunk: int = CHUNK) -> DataFrame:
    """The rows that are not contaminated, all columns as they are."""
    names, place = docs.columns, docs.columns.index("text")
    for number, table in enumerate(tables(benchmark, chunk)):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            for batch in batches:
                batch = batch.rename_columns([str(i) for i in range(batch.num_columns)])
                for part in hashing.slices(batch, str(place)):
                    keep = np.ones(part.num_rows, bool)
                    keep[list(matches(part.column(place), shared.value, coverage))] = False
                    yield part.filter(pa.array(keep)).rename_columns(names)

        if number:
            docs = _between(docs, "decontaminated")
        docs = map_batches(docs, run, docs.schema)
    return docs
