"""Contiguous shards of nearly equal size from global prefix sums.

Rows are put in one global order by a range sort.  Every partition sums its own sizes; the sums
over earlier partitions come from one row per partition, and a row belongs to the shard in whose
equal share of all bytes its middle falls.  Only ids, sizes and checksums move, never texts.

The order is text checksum, then id: equal texts are neighbours, and a group of them that is
small against a shard goes to one shard as a whole; a larger group is cut like any other rows,
so a group with a third of all rows does no harm.  Shard sizes differ from the target by at most
the larger of one row and `WHOLE` of a shard at either end.

The size of a row is its text's number of UTF-8 bytes plus one (a null text has no bytes, and no
checksum).  Repeated rows and ids are rows of their own, in either order; null ids come first.  An
empty table gives no rows.  Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import scratch_folder

SHARDS = 8
#: Groups of up to this part of a shard are not cut
WHOLE = 0.05


def _written(frame: DataFrame, name: str) -> DataFrame:
    folder = scratch_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number, the bytes before each row in it and the row's number."""
    block, before, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        ends = before + np.cumsum(size)
        yield pa.record_batch(
            [*batch.columns, pa.array(np.full(len(size), block, np.int32)), pa.array(ends - size),
             pa.array(np.arange(rows, rows + len(size)))],
            [*batch.schema.names, "block", "before", "row"])
        if len(size):
            before, rows = int(ends[-1]), rows + len(size)


def shards(docs: DataFrame, count: int = SHARDS, whole: float = WHOLE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    # Sorting reads its input twice, for the bounds and for the rows: texts are read once before.
    keys = _written(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("text_hash")), "sizes")
    # The last key spreads equal rows over partitions.
    order = ["text_crc32", "text_hash", "doc_id", "tie"]
    ordered = keys.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    fields = "doc_id long, size long, text_crc32 long, text_hash long"
    blocks = _written(
        ordered.drop("tie").mapInArrow(_number, f"{fields}, block int, before long, row long"), "blocks")
    # One row per partition of the sort: what the window and the broadcast see is that small.
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).select(
        "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    placed = blocks.join(F.broadcast(totals), "block").select(
        "doc_id", "size", "text_crc32", "text_hash", "total", (F.col("before") + F.col("bytes_before")).alias("start"),
        (F.col("row") + F.col("rows_before")).alias("number"))
    # Groups that lie over a cut are few: at most one per cut. Only they need to be looked at.
    middle = f"least({count - 1}, ((2 * start + size) * {count}) DIV (2 * total))"
    placed = placed.withColumn("shard", F.expr(middle))
    split = placed.groupBy("text_crc32", "text_hash").agg(
        F.min("start").alias("group_start"), F.sum("size").alias("group_size"), F.min("shard").alias("low"),
        F.max("shard").alias("high"), F.first("total").alias("all")).where("low < high").where(
            F.col("group_size") * count <= whole * F.col("all")).select(
                F.col("text_crc32").alias("group_crc"), F.col("text_hash").alias("group_hash"),
                F.expr(f"least({count - 1}, ((2 * group_start + group_size) * {count}) DIV (2 * all))").alias("together"))
    placed = _written(
        placed.join(F.broadcast(split), F.col("text_crc32").eqNullSafe(F.col("group_crc"))
                    & (F.col("text_hash") == F.col("group_hash")), "left").select(
            "doc_id", "size", "text_crc32", F.coalesce("together", "shard").cast("int").alias("shard"), "number"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("number").alias("first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("number") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
