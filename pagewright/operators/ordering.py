"""Ordered computations that hold up when one group has a third of all rows.

A window over a whole table, or over one hot host, would put everything into one task.
`ordered_blocks` instead sorts by range into blocks; numbers and running sums then
need only the totals of the earlier blocks, one row per block and group.  Equal keys may
lie in several blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import scratch_folder


# Bits of the running number within a partition, as Spark's own row ids have them.
_ROW_BITS = 33


def ordered_blocks(rows: DataFrame, order: list, costly: bool = False) -> DataFrame:
    """Rows sorted by range, with ``_block`` and ``_row`` (0-based position in the block).

    The sorted rows are written to the shared scratch folder, so block bounds stay the
    same however often the result is read and an executor loss repeats no sort.  A range
    sort reads its input twice (bounds, then rows); `costly` inputs are written first.
    """
    spark = rows.sparkSession
    if costly:
        staged = scratch_folder(spark, "staged")
        rows.write.parquet(staged)
        rows = spark.read.schema(rows.schema).parquet(staged)
    folder = scratch_folder(spark, "ordered")
    # The last key tells equal rows apart, so that one repeated key cannot fill a block.  The place
    # is taken in the task that sorted the rows: partition and running number in it.
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie").withColumn(
        "_at", F.monotonically_increasing_id())
    ordered.write.parquet(folder)
    blocks = spark.read.schema(ordered.schema).parquet(folder)
    return blocks.withColumn("_block", F.shiftright("_at", _ROW_BITS)).withColumn(
        "_row", F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_at")


def number_within(rows: DataFrame, group: str, order: list[str], name: str = "number") -> DataFrame:
    """0-based numbers within each group, without a window over the group."""
    whole = number_rows(rows, [group, *order], "_whole")
    first = whole.groupBy(F.col(group).alias("_group")).agg(F.min("_whole").alias("_first"))
    return whole.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(
        name, F.col("_whole") - F.col("_first")).drop("_whole", "_group", "_first")


def number_rows(rows: DataFrame, order: list, name: str = "number", costly: bool = False, keep_block: bool = False) -> DataFrame:
    """1-based numbers over the whole table in the given order.

    With `keep_block` the rows tell in which sorted block they are (`_block`, from 0), see `in_order`.
    """
    blocks = ordered_blocks(rows, order, costly)
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    # One row per block: the window below sees as many rows as the sort had tasks.
    starts = sizes.selectExpr(
        "_block", "coalesce(sum(_size) OVER (ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND 1 PRECEDING), 0) AS _start")
    return blocks.join(starts, "_block").withColumn(
        name, F.col("_start") + F.col("_row") + 1).drop("_row", "_start", *([] if keep_block else ["_block"]))


def in_order(numbered: DataFrame, name: str = "number") -> DataFrame:
    """Numbered rows with their blocks (`keep_block`) as partitions in order, without another sort of the whole."""
    last = numbered.agg(F.max("_block")).first()[0]
    if last is None:
        return numbered.drop("_block")
    return numbered.repartitionById(last + 1, F.col("_block").cast("int")).sortWithinPartitions(name).drop("_block")


def running_offsets(rows: DataFrame, group: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The sum of `value` over the earlier rows of the same group."""
    blocks = ordered_blocks(rows.withColumn("_value", value), [*group, *order])
    totals = blocks.groupBy(*group, "_block").agg(F.sum("_value").alias("_total"))
    keys = ", ".join(group)
    starts = totals.selectExpr(
        *group, "_block", f"coalesce(sum(_total) OVER (PARTITION BY {keys} ORDER BY _block "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _start")
    inside = (f"coalesce(sum(_value) OVER (PARTITION BY {keys}, _block ORDER BY _row "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return (
        blocks.selectExpr("*", f"{inside} AS _inside").join(starts, [*group, "_block"])
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_block", "_row", "_value", "_inside", "_start")
    )


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key.  Partial aggregation leaves one row per key and task."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*key).agg(first.alias("_first")).select(
        *key, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]])


def waves(rows: DataFrame, order: list, workers: int) -> DataFrame:
    """C4: batches of at most `workers` rows, numbered from 0."""
    return number_rows(rows, order, "_number").withColumn(
        "wave", F.floor((F.col("_number") - 1) / workers)).drop("_number")


def schedule(frontier: DataFrame, min_delay: float = 1.0, max_delay: float = 3.0,
             host: str = "host", order: list | None = None) -> DataFrame:
    """Per host, the second at which each request may start.

    Each request waits for the delays of the earlier requests to its host.  A delay is
    uniform in [min_delay, max_delay), derived from the URL, and at least 0.1 s.
    """
    share = F.expr("pmod(xxhash64(url), 1000000) / 1000000D")
    delay = F.greatest(F.lit(0.1), F.lit(float(min_delay)) + share * (max_delay - min_delay))
    delayed = frontier.withColumn("delay", delay)
    return running_offsets(delayed, [host], order or ["depth", "url"], F.col("delay"), "starts_after")


def by_relevance(links: DataFrame, priority: bool = False) -> DataFrame:
    """By relevance, highest first; ties by document order, or by priority first."""
    order = [F.desc("relevance_score")] + ([F.asc("priority")] if priority else []) + [
        F.asc(c) for c in ("page_id", "pos") if c in links.columns]
    return links.orderBy(*order)


def top_per_page(links: DataFrame, n: int = 50, page: str = "page_id") -> DataFrame:
    """The first `n` links of each page; tasks drop the rest before the shuffle."""
    return links.selectExpr("*", f"row_number() OVER (PARTITION BY {page} ORDER BY pos) AS _n").filter(
        F.col("_n") <= n).drop("_n")
