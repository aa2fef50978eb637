"""Approximate nearest neighbours by cosine on robust-pruned graphs.

Vectors are dealt by a hash of their id into shards of bounded size.  Each shard has a directed
graph over its vectors: a greedy search from the entry point proposes neighbours of a new vector,
and of those, nearest first, one is kept unless a kept one is closer to it by the factor `ALPHA`.
Edges go both ways and are pruned again where a vector gets more than `DEGREE` of them.  A query
runs a beam search on every shard, and the best of all shards are its neighbours.

Building and searching work on many vectors at a time, so numpy does the arithmetic.  The index
is a table in the shared scratch folder: a lost executor repeats one shard.  Scores are cosines of
the original vectors in double precision.

Vectors that are equal up to a power of two are one node of the graph, so a group of copies costs no
edges, whatever its size.  Scaling by a power of two is exact, so rows of a node have the same cosine with any
vector to the last bit, and exactly 1 with each other.  A table of members holds the smallest ids of
each node, which are joined to the nodes that a search found; a query's own node is not searched for.
A node is named by 128 bits of hashes of its vector.

Vectors that are null, zero, empty or hold null or non-finite components take no part, neither as
queries nor as candidates.  All other rows are candidates of all others: those that repeat a vec_id,
with the same or another vector, count each, as queries too, and a row without a vec_id is a candidate.
Vectors of another length are no candidates of each other.  Scores lie from -1 to 1; equal ones go
to the smaller vec_id, a null one last.  An empty table gives no rows.  Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import scratch_folder, written

#: Vectors of a shard, at most about
SHARD = 6_000
DEGREE, ALPHA, BUILD_BEAM, BEAM = 32, 1.2, 56, 128
BATCH = 256


def search(vectors: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int):
    """Beam search for many queries: the found vectors' numbers (or -1) and similarities, best first."""
    rows, n = len(queries), len(vectors)
    at = np.arange(rows)
    found = np.full((rows, beam), -1, np.int64)
    near = np.full((rows, beam), -np.inf, np.float32)
    # Empty places count as expanded: there is nothing to follow.
    expanded = np.ones((rows, beam), bool)
    seen = np.zeros((rows, n), bool)
    found[:, 0], near[:, 0], expanded[:, 0] = entry, queries @ vectors[entry], False
    seen[:, entry] = True
    active = at
    while len(active):
        open_near = np.where(expanded[active], -np.inf, near[active])
        best = open_near.argmax(1)
        going = open_near[np.arange(len(active)), best] > -np.inf
        active, best = active[going], best[going]
        if not len(active):
            break
        expanded[active, best] = True
        around = edges[found[active, best]]
        fresh = (around >= 0) & ~seen[active[:, None], around]
        seen[active[:, None], np.where(fresh, around, found[active, best][:, None])] = True
        similar = np.einsum("brd,bd->br", vectors[around], queries[active])
        similar[~fresh] = -np.inf
        names = np.concatenate([found[active], around], 1)
        values = np.concatenate([near[active], similar], 1)
        closed = np.concatenate([expanded[active], ~fresh], 1)
        keep = np.argpartition(-values, beam - 1, 1)[:, :beam]
        found[active], near[active] = np.take_along_axis(names, keep, 1), np.take_along_axis(values, keep, 1)
        expanded[active] = np.take_along_axis(closed, keep, 1)
    order = np.argsort(-near, 1, kind="stable")
    found, near = np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)
    return np.where(near > -np.inf, found, -1), near


def prune(vectors: np.ndarray, centre: np.ndarray, pool: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning for many vectors: up to `degree` of each row of candidates (or -1) stay.

    A candidate goes if a kept one, nearer to the centre, is nearer to the candidate by the
    factor alpha than the centre is.  Distances are Euclidean on unit vectors.
    """
    rows = np.arange(len(centre))
    pool = np.where(pool == centre[:, None], -1, pool)
    # A candidate that comes twice counts once.
    pool = np.sort(pool, 1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    points = vectors[pool]
    far = np.where(pool >= 0, 2 - 2 * np.einsum("bmd,bd->bm", points, vectors[centre]), np.inf).astype(np.float32)
    kept = np.full((len(centre), degree), -1, np.int64)
    left = far.copy()
    for k in range(degree):
        best = left.argmin(1)
        there = left[rows, best] < np.inf
        if not there.any():
            break
        kept[there, k] = pool[there, best[there]]
        between = 2 - 2 * np.einsum("bmd,bd->bm", points, points[rows, best])
        gone = (alpha * alpha * between <= far) & there[:, None]
        left[gone] = np.inf
        left[rows, best] = np.inf
    return kept


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
    """Edges (or -1) of the graph over unit vectors, and its entry point."""
    n = len(vectors)
    edges = np.full((n, degree), -1, np.int64)
    entry = int((vectors @ vectors.mean(0)).argmax())
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < n:
        # Batches grow with the graph, so most of what a vector should meet is there.
        batch = order[done: done + min(BATCH, max(1, done))]
        done += len(batch)
        pool, _ = search(vectors, edges, entry, vectors[batch], beam)
        # Members of a batch don't find each other: offer them the nearest ones.
        among = vectors[batch] @ vectors[batch].T
        np.fill_diagonal(among, -np.inf)
        nearest = np.argsort(-among, 1, kind="stable")[:, : min(16, len(batch) - 1)]
        edges[batch] = prune(vectors, batch, np.concatenate([pool, batch[nearest]], 1), degree, alpha)
        _add_back(vectors, edges, batch, degree, alpha)
    return edges, entry


def _add_back(vectors: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back to the batch; where there is no room, all are pruned together."""
    source = np.repeat(batch, degree)
    target = edges[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    # One new edge per round and target would be slow: a round takes up to `degree` of them.
    while len(target):
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        names, first, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, count)
        now = rank < degree
        extra = np.full((len(names), min(degree, int(count.max()))), -1, np.int64)
        extra[np.repeat(np.arange(len(names)), count)[now], rank[now]] = source[now]
        pool = np.concatenate([edges[names], extra], 1)
        pool = np.where(pool == names[:, None], -1, pool)
        ordered = -np.sort(-pool, 1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        ordered = -np.sort(-ordered, 1)
        fits = (ordered >= 0).sum(1) <= degree
        edges[names[fits]] = ordered[fits, :degree]
        for at in range(0, len(names), 4 * BATCH):
            full = np.flatnonzero(~fits)[at: at + 4 * BATCH]
            if len(full):
                edges[names[full]] = prune(vectors, names[full], pool[full], degree, alpha)
        source, target = source[~now], target[~now]


def _unit(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    # Scaled first, so that squares of very large or small components stay finite.
    wide = wide / np.abs(wide).max(1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(1, keepdims=True))


def valid_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part."""
    fine = f"{vector} IS NOT NULL AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists({vector}, x -> x <> 0)"
    return embeddings.where(fine).select("vec_id", F.col(vector).cast("array<double>").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def _groups(batches: Iterator[pa.RecordBatch], key: str):
    """Rows of each run of equal keys, as soon as the next run begins."""
    held, at = [], None
    for batch in batches:
        names = batch.column(key).to_pylist()
        begin = 0
        for end in range(1, len(names) + 1):
            if end < len(names) and names[end] == names[begin]:
                continue
            if at is not None and names[begin] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = names[begin]
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield at, pa.Table.from_batches(held)


def build_index(vectors: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """shard, node, key, vec_id, vector, edges (nodes of the shard) and entry of every vector.

    A row's key is its name, by default its vec_id; the vec_id decides ties.
    """
    spark = vectors.sparkSession
    schema = "shard string, node int, key string, vec_id long, vector array<double>, edges array<int>, entry int"
    vectors = _named(vectors)
    sizes = vectors.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    # One row per vector length; the number of shards follows the number of vectors.
    counts = {r["width"]: -(-r["n"] // shard_size) for r in sizes.collect()}
    if not counts:
        return spark.createDataFrame([], schema)
    many = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    dealt = vectors.withColumn("shard", F.concat_ws(
        "-", F.size("vector"), F.pmod(F.xxhash64("key"), F.element_at(many, F.size("vector")).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]):
        for shard, rows in _groups(batches, "shard"):
            units = _unit(_matrix(rows.column("vector"))).astype(np.float32)
            edges, entry = build(units)
            present = edges >= 0
            offsets = np.concatenate([[0], np.cumsum(present.sum(1))]).astype(np.int32)
            n = rows.num_rows
            for table in pa.table({
                "shard": rows.column("shard"), "node": pa.array(np.arange(n, dtype=np.int32)), "key": rows.column("key"), "vec_id": rows.column("vec_id"),
                "vector": rows.column("vector"), "edges": pa.ListArray.from_arrays(pa.array(offsets), pa.array(edges[present].astype(np.int32))),
                "entry": pa.array(np.full(n, entry, np.int32)),
            }).to_batches(max_chunksize=2_000):
                yield table

    folder = scratch_folder(spark, "vector-index")
    dealt.select("shard", "key", "vec_id", "vector").repartition(max(1, sum(counts.values())), "shard").sortWithinPartitions(
        "shard", "vec_id", "key").mapInArrow(run, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _named(vectors: DataFrame) -> DataFrame:
    return vectors if "key" in vectors.columns else vectors.withColumn("key", F.col("vec_id").cast("string"))


def neighbours(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score and key of the k nearest of each query, but for its own key.

    Queries have vector, and vec_id or key, which is their query_id.
    """
    named = "key" in queries.columns
    # Every query visits every shard of its length; the rows of a shard come before its queries.
    last = F.max(F.substring_index("shard", "-", -1).cast("int"))
    shards = index.groupBy(F.size("vector").alias("width")).agg(last.alias("last"))  # one row per vector length
    visits = _named(queries).join(shards, F.size("vector") == F.col("width")).select(
        F.explode(F.expr("transform(sequence(0, last), s -> concat_ws('-', width, s))")).alias("shard"), F.lit(1).alias("kind"), F.lit(0).alias("node"), "key", F.lit(0).cast("long").alias("vec_id"), "vector",
        F.expr("CAST(array() AS array<int>)").alias("edges"), F.lit(0).alias("entry"))
    rows = index.select("shard", F.lit(0).alias("kind"), "node", "key", "vec_id", "vector", "edges", "entry").unionByName(visits)

    def run(batches: Iterator[pa.RecordBatch]):
        shard, held, graph = None, [], None

        def ready():
            table = pa.Table.from_batches(held)
            exact = _matrix(table.column("vector"))
            lists = table.column("edges").combine_chunks()
            sizes = np.diff(np.asarray(lists.offsets))
            edges = np.full((len(exact), DEGREE), -1, np.int64)
            edges[np.arange(DEGREE) < sizes[:, None]] = np.asarray(lists.flatten())
            ids, keys = table.column("vec_id").to_numpy(), np.array(table.column("key").to_pylist())
            return _unit(exact).astype(np.float32), edges, table.column("entry")[0].as_py(), _scaled(exact), ids, keys

        for batch in batches:
            names, kinds = batch.column("shard").to_pylist(), batch.column("kind").to_pylist()
            begin = 0
            for end in range(1, len(names) + 1):
                if end < len(names) and names[end] == names[begin] and kinds[end] == kinds[begin] and end - begin < 4 * BATCH:
                    continue
                part = batch.slice(begin, end - begin)
                if names[begin] != shard:
                    shard, held, graph = names[begin], [], None
                if kinds[begin] == 0:
                    held.append(part)
                elif held:  # no vector may have been dealt to this shard
                    graph = graph or ready()
                    yield _answer(graph, part, k, beam)
                begin = end

    answers = rows.repartition("shard").sortWithinPartitions("shard", "kind", "node").mapInArrow(
        run, "query string, key string, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "key")
    query = F.col("query") if named else F.col("query").cast("long")
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        query.alias("query_id"), "rank", "vec_id", "score", "key")


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its squares stay finite: exact, and without effect on cosines."""
    _, exponent = np.frexp(np.abs(rows).max(1, keepdims=True))
    return np.ldexp(rows, -exponent)


def _answer(graph, queries: pa.RecordBatch, k: int, beam: int) -> pa.RecordBatch:
    short, edges, entry, exact, ids, keys = graph
    own = np.array(queries.column("key").to_pylist())
    asked = _scaled(_matrix(queries.column("vector")))
    found, _ = search(short, edges, entry, _unit(asked).astype(np.float32), min(beam, max(k + 1, len(short))))
    # Short numbers find, the original ones decide; equal scores go to the smaller id.
    near = exact[found]
    squares = np.einsum("bmd,bmd->bm", near, near) * np.einsum("bd,bd->b", asked, asked)[:, None]
    scores = np.clip(np.einsum("bmd,bd->bm", near, asked) / np.sqrt(squares), -1, 1)
    ids, keys = ids[found], keys[found]
    scores[(found < 0) | (keys == own[:, None])] = -np.inf
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    scores, ids, keys = (np.take_along_axis(x, order, 1) for x in (scores, ids, keys))
    there = scores > -np.inf
    return pa.record_batch(
        [pa.array(np.repeat(own, there.sum(1)).astype(object), pa.string()), pa.array(keys[there].astype(object), pa.string()), pa.array(ids[there]),
         pa.array(scores[there])], ["query", "key", "vec_id", "score"])


#: Stands for no vec_id where ties are decided
LAST = 2 ** 63 - 1


def members(vectors: DataFrame, k: int) -> DataFrame:
    """key, vec_id, n and vector of the k smallest ids of every node, given vectors with their keys.

    Only the first row of a node (n = 1) has the vector.  Tasks drop what is beyond the k smallest
    before the shuffle.
    """
    first = Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last())
    few = vectors.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    return written(few.select("key", "vec_id", "n", F.when(F.col("n") == 1, F.col("vector")).alias("vector")), "vector-members")


def with_keys(vectors: DataFrame) -> DataFrame:
    """vec_id, vector scaled by a power of two so that its largest component is from 1 to 2, and key.

    The logarithm may be off by one next to a power of two, which is mended, so that vectors that
    differ by a power of two get the same row.
    """
    largest = vectors.select("vec_id", "vector", F.expr("array_max(transform(vector, x -> abs(x)))").alias("m"))
    about = largest.withColumn("p", F.expr("pow(2D, floor(log2(m)))"))
    power = about.withColumn("p", F.expr("CASE WHEN p > m THEN p / 2 WHEN 2 * p <= m THEN 2 * p ELSE p END"))
    # Adding zero turns a negative zero into zero.
    scaled = power.select("vec_id", F.expr("transform(vector, x -> x / p + 0D)").alias("vector"))
    return scaled.withColumn("key", F.concat_ws("-", F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")))


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, beam: int = BEAM, shard_size: int = SHARD) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by `every`, among all other rows."""
    vectors = with_keys(valid_vectors(embeddings))
    # A query may be among the rows of its node: one more than k.
    known = members(vectors, k + 1)
    index = build_index(known.where("n = 1").select("key", F.coalesce("vec_id", F.lit(LAST)).alias("vec_id"), "vector"), shard_size)
    asked = written(vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("key").alias("asked")), "vector-queries")
    # Each node is searched for once, however many queries it holds.  Of the k best rows none
    # lies outside the k best other nodes: each of those has a row, its smallest id, that comes first.
    own = asked.select(F.col("asked").alias("key")).distinct()
    found = neighbours(index, index.join(own, "key", "left_semi").select("key", "vector"), k, beam).select(
        F.col("query_id").alias("asked"), "key", "score")
    # A vector's cosine with itself, and with itself times a power of two, is exactly 1.
    hits = found.unionByName(own.select(F.col("key").alias("asked"), "key", F.lit(1.0).alias("score")))
    rows = known.groupBy("key").agg(F.collect_list(F.struct("vec_id")).alias("rows"))
    entry = F.struct((-F.col("score")).alias("far"), F.coalesce("r.vec_id", F.lit(LAST)).alias("tie"), "r.vec_id", (F.col("asked") == F.col("key")).alias("own"))
    best = hits.join(rows, "key").select("asked", "key", F.explode("rows").alias("r"), "score").groupBy("asked").agg(
        F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("best"))
    # One row of the query's own node that has its id is the query.
    itself = "array_position(transform(best, b -> coalesce(b.own AND b.vec_id = query_id, false)), true)"
    return asked.join(best, "asked").withColumn("itself", F.expr(itself)).select(
        "query_id", F.expr(f"posexplode(slice(filter(best, (b, i) -> i + 1 <> itself), 1, {k})) AS (place, b)")).select(
            "query_id", (F.col("place") + 1).alias("rank"), "b.vec_id", (-F.col("b.far")).alias("score"))
