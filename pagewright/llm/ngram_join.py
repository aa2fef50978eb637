"""Similarity join of documents on their sets of word n-grams.

1. Every text becomes its set of n-grams, a 128-bit key of that set and MinHash bands.  Texts with
   equal sets are copies; from here on one representative stands for them.
2. Representatives that agree in a band are candidates.  Each band bucket links its members to the
   smallest one only, and connected components of these links are the candidate families, so no
   list of pairs within a bucket is ever made.
3. The full sets of candidates are read again and every pair in a family is decided on them.  A
   large family is cut into blocks, and each task compares two blocks: it returns link counts and
   a spanning forest of its links, never the pairs.
4. Components of the forests are the classes of similar documents.

Band and row counts are chosen for a target recall at the threshold; a pair above it is missed
with a chance of at most ``1 - RECALL``.  A pair in a family is compared exactly, whatever its bands.

Texts with fewer than n words have one n-gram (all their words); texts without words, and null
texts, have none and are a class of their own.  Repeated rows and equal texts are copies of each
other.  A null doc_id takes part and counts as larger than all others when a class is named.
Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import hashing
from pagewright.llm.graphs import connected_components
from pagewright.session import map_batches, scratch_folder

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9998
#: Most hash functions that a choice of bands may need
MOST_HASHES = 200
#: Members of a block; a task holds two blocks
BLOCK = 400


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most selective rows whose bands reach the recall at the threshold."""
    best = None
    for rows in range(1, most + 1):
        if threshold ** rows >= 1:
            return 1, rows
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-threshold ** rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("no choice of bands reaches this recall with so few hash functions")
    return best


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    draws = hashing.mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (draws[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (draws[count:] >> np.uint64(32)).astype(np.uint32)


def set_keys(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each set, from sums of two independent hashes of its members."""
    sums = np.zeros((2, len(grams) + 1), np.uint64)
    np.cumsum(hashing.mix(grams + np.uint64(0x632BE59BD9B4E019)), out=sums[0, 1:])
    np.cumsum(hashing.mix(grams ^ np.uint64(0xA0761D6478BD642F)), out=sums[1, 1:])
    out = sums[:, starts[1:]] - sums[:, starts[:-1]]
    return hashing.mix(out + np.diff(starts).astype(np.uint64))


def band_hashes(grams: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band's minima for every set; zero for empty sets."""
    factor, shift = _seeds(bands * rows)
    out = np.zeros((len(starts) - 1, bands), np.uint64)
    weight = hashing.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salt = hashing.mix(np.arange(101, bands + 101, dtype=np.uint64))
    short = (grams >> np.uint64(17)).astype(np.uint32)
    for i in range(len(out)):
        own = short[starts[i]: starts[i + 1]]
        if not len(own):
            continue
        least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(own), 2048):
            np.minimum(least, (own[at: at + 2048, None] * factor ^ shift).min(0), out=least)
        out[i] = (hashing.mix(least.astype(np.uint64).reshape(bands, rows)) * weight).sum(1)
    return hashing.mix(out + salt)


def _binary_keys(keys: np.ndarray) -> pa.Array:
    """The pairs of numbers as 16 bytes each."""
    data = np.ascontiguousarray(keys.T.astype(">u8")).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), keys.shape[1], [None, pa.py_buffer(data)]).cast(pa.binary())


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key, size and bands of every row."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                grams, starts = hashing.shingle_sets(part.column("text"), n)
                values = band_hashes(grams, starts, bands, rows).astype(np.int64).ravel()
                offsets = np.arange(0, len(values) + 1, bands, dtype=np.int32)
                yield pa.record_batch(
                    [part.column("doc_id"), _binary_keys(set_keys(grams, starts)), pa.array(np.diff(starts).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "key", "size", "bands"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, key binary, size int, bands array<long>")


def _written(frame: DataFrame, name: str) -> DataFrame:
    folder = scratch_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def _candidate_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """key and n-gram set of the representatives in `wanted` (key, doc_id).

    A bitmap of their ids keeps other texts out of the pass; the join is exact.
    """
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(hashing.bitmap_of(wanted.select(F.xxhash64("doc_id").alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            known = hashing.in_bitmap(bitmap.value, batch.column("h").to_numpy(zero_copy_only=False).astype(np.uint64))
            for part in hashing.slices(batch.filter(pa.array(known)), "text"):
                grams, starts = hashing.shingle_sets(part.column("text"), n)
                data = grams.tobytes()
                sets = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts * 8), pa.py_buffer(data)])
                yield pa.record_batch(
                    [part.column("doc_id"), _binary_keys(set_keys(grams, starts)), sets.cast(pa.binary())],
                    ["doc_id", "key", "grams"])

    sets = map_batches(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")), run, "doc_id long, key binary, grams binary")
    same = (F.col("s.key") == F.col("w.key")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id"))
    return sets.alias("s").join(wanted.alias("w"), same).select("w.*", "s.grams")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float):
    """For each member of `left`, the members of `right` whose sets are similar enough.

    Members are numbers into `sets`.  Yields (member, similar members); in a block compared with
    itself each pair comes once.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names) + 1, np.int32)
    same = left is right
    order = right[np.argsort(sizes[right], kind="stable")]
    flat = np.concatenate([ids[starts[m]: starts[m + 1]] for m in order])
    bounds = np.concatenate([[0], np.cumsum(sizes[order])])
    ordered = sizes[order]
    rank = {m: i for i, m in enumerate(order)} if same else None
    for m in left:
        # Only sets of a fitting size can be similar enough; of equal pairs the later is skipped.
        low = rank[m] + 1 if same else int(np.searchsorted(ordered, np.floor(sizes[m] * threshold)))
        high = int(np.searchsorted(ordered, np.ceil(sizes[m] / threshold), "right"))
        if low >= high:
            continue
        own = ids[starts[m]: starts[m + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat[bounds[low]: bounds[high]]], bounds[low:high] - bounds[low])
        mark[own] = 0
        # The ratio of whole numbers, compared without rounding: common / union >= threshold.
        union = sizes[m] + ordered[low:high] - common
        yield m, order[low:high][common >= threshold * union - 1e-9]


def _compare(rows: list[dict], threshold: float, first: bool) -> tuple[list, list]:
    """Link counts of one pair of blocks and a spanning forest of its links."""
    block = np.array([r["block"] for r in rows])
    sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    copies = np.array([r["copies"] for r in rows])
    lower = np.flatnonzero(block == block.min())
    upper = lower if first else np.flatnonzero(block != block.min())
    classes, docs = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    parent = np.arange(len(rows))
    forest = []

    def root(x):
        while (parent[x] != parent[parent[x]]).any():
            parent[x] = parent[parent[x]]
        return parent[x]

    if len(lower) and len(upper):
        for m, others in linked(sets, lower, upper, threshold):
            if not len(others):
                continue
            classes[m] += len(others)
            docs[m] += copies[others].sum()
            classes[others] += 1
            docs[others] += copies[m]
            mine = root(np.array([m]))[0]
            roots, where = np.unique(root(others), return_index=True)
            for r, at in zip(roots, where):
                if r != mine:
                    parent[r] = mine
                    forest.append((m, others[at]))
    return [(i, classes[i], docs[i]) for i in np.flatnonzero(classes)], forest


def _compare_families(threshold: float):
    """Reads rows sorted by family and pair of blocks; returns counts (b null) and links."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("classes", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        held, at, out = [], None, []

        def finish():
            unique = list({r["key"]: r for r in held}.values())
            if len(unique) > 1:
                counts, forest = _compare(unique, threshold, at[1] == at[2])
                out.extend((unique[i]["key"], None, int(c), int(d)) for i, c, d in counts)
                out.extend((unique[i]["key"], unique[j]["key"], 0, 0) for i, j in forest)

        def flush():
            columns = list(zip(*out))
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                place = (row["family"], row["low"], row["high"])
                if place != at:
                    if held:
                        finish()
                    held, at = [], place
                held.append(row)
                if len(out) > 20_000:
                    yield flush()
                    out.clear()
        if held:
            finish()
        if out:
            yield flush()

    return run


def similar_documents(
    docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Keys of all rows, and the classes of all keys.

    The first table has doc_id and key of every row.  The second has for each key: copy_id (smallest
    doc_id with this set), copies, first_rows (rows with that doc_id and set), class_id (smallest
    doc_id of the class), leader (whether this key has it), linked_sets and linked_docs (other sets
    and their documents with at least the threshold's similarity).
    """
    bands, rows = choose_bands(threshold, recall)
    marked = _written(signatures(docs, n, bands, rows), "signatures")
    # Equal sets have equal bands, so any of them will do.  Empty sets are nobody's copies.
    keyed = marked.withColumn("key", F.when(F.col("size") > 0, F.col("key")))
    sets = _written(
        keyed.where("key IS NOT NULL").groupBy("key").agg(
            F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "sets")
    member = sets.select("key", F.posexplode("bands").alias("band", "bucket")).select(
        "key", F.xxhash64("band", "bucket").alias("bucket"))
    hubs = member.groupBy("bucket").agg(F.min("key").alias("hub"), F.count("*").alias("members")).where("members > 1")
    near = member.join(hubs, "bucket").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    families = connected_components(near)
    sized = families.groupBy("component").agg(F.count("*").alias("members"))
    candidates = _written(
        families.join(sized, "component").join(sets.select(F.col("key").alias("node"), "copy_id", "copies"), "node").select(
            F.col("node").alias("key"), F.col("copy_id").alias("doc_id"), "copies", F.col("component").alias("family"),
            F.ceil(F.col("members") / block).cast("int").alias("blocks")), "candidates")
    own = _candidate_sets(docs, candidates, n).withColumn("block", F.expr("cast(pmod(xxhash64(key), blocks) AS int)"))
    # Each member meets every block of its family once: a row for each pair of blocks.
    dealt = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", "copies", "grams", "family", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = _written(
        map_batches(
            dealt.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high"), _compare_families(threshold), "a binary, b binary, classes long, docs long"), "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(
        F.sum("classes").alias("linked_sets"), F.sum("docs").alias("linked_docs"))
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    named = sets.select("key", "copy_id", "copies").join(groups.withColumnRenamed("node", "key"), "key", "left").join(
        counts, "key", "left").select(
            "key", "copy_id", "copies", F.coalesce("component", "key").alias("component"),
            F.coalesce("linked_sets", F.lit(0)).alias("linked_sets"), F.coalesce("linked_docs", F.lit(0)).alias("linked_docs"))
    named = _written(named, "classes")
    # The class is named after its smallest document; ties of repeated ids go to the smallest key.
    heads = named.groupBy("component").agg(
        F.min(F.struct(F.col("copy_id").isNull().alias("n"), "copy_id", "key")).alias("head")).select(
            "component", F.col("head.copy_id").alias("class_id"), F.col("head.key").alias("leader"))
    # Written, so that both sides of the join are shuffled for it and a large class can be split.
    classes = named.join(_written(heads, "heads"), "component").select(
        "key", "copy_id", "copies", "class_id", (F.col("leader") == F.col("key")).alias("leader"), "linked_sets", "linked_docs")
    return keyed.select("doc_id", "key"), _written(classes, "named")


def similarity_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: class_id, copy_id, copies (others with the same set) and links.

    `links` counts the other documents with another set of at least the threshold's similarity,
    `linked_sets` their distinct sets.
    """
    rows, classes = similar_documents(docs, **options)
    return rows.join(classes, "key", "left").select(
        "doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce(F.col("copies") - 1, F.lit(0)).alias("copies"),
        F.coalesce("linked_docs", F.lit(0)).alias("links"), F.coalesce("linked_sets", F.lit(0)).alias("linked_sets"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of one document per class, all columns as they are; texts without words all stay."""
    rows, classes = similar_documents(docs, **options)
    return _keep(docs, classes, options.get("n", WORDS))


def _keep(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    names = docs.columns
    fields = [str(i) for i in range(len(names))]
    plain = docs.toDF(*fields)
    text, doc_id = fields[names.index("text")], fields[names.index("doc_id")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in hashing.slices(batch, text):
                grams, starts = hashing.shingle_sets(part.column(text), n)
                keys = _binary_keys(set_keys(grams, starts))
                none = pa.array(np.diff(starts) == 0)
                yield pa.record_batch([*part.columns, pc.if_else(none, pa.scalar(None, pa.binary()), keys)], [*fields, "key"])

    from pyspark.sql.types import BinaryType, StructType

    schema = StructType(list(plain.schema.fields)).add("key", BinaryType())
    keyed = map_batches(plain, run, schema)
    leaders = classes.where("leader").select(F.col("key").alias("leader_key"), "copy_id")
    kept = keyed.where("key IS NOT NULL").join(
        leaders, (F.col("key") == F.col("leader_key")) & F.col(doc_id).eqNullSafe(F.col("copy_id")))
    # A repeated row has the same key and id: one of them stays, which needs no further shuffle.
    one = kept.dropDuplicates(["key"]).select(*fields)
    return keyed.where("key IS NULL").select(*fields).unionAll(one).toDF(*names)
