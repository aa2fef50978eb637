"""A trie of conversation prefixes, in shards of balanced parentheses.

A node is a sequence of turns with which some conversation begins; what conversations share need
be stored (or computed) once.  The trie tells for every node how many conversations begin with it,
how many leaves are below it and how much its subtree saves.

1. *Order.*  Conversations are sorted as sequences of turns: runs of 16 turns get numbers in the
   order of a range sort, then runs of 16 such numbers, and so on, so no row holds more than 16
   turns however long a conversation is.  Equal conversations are one sequence.
2. *Preorder.*  With the length of the prefix that a sequence shares with the one before it, its
   further turns are the next nodes of the trie in preorder, and the depth that follows each node is known.
3. *Shards.*  Every `SHARD` nodes in that order are one row: parentheses, and the nodes' values as
   arrays.  In a shard, the end of a subtree is where its parenthesis closes (range min-max blocks of the
   excess), ranks of `()` pairs count its leaves, and differences of cumulative arrays give its sums.
4. *Spines.*  Nodes still open at the end of a shard form its spine, one per depth.  Which later shard
   closes which depths follows from two depths per shard; that shard sends its sums up to there,
   and the children it has of nodes on the spine; shards answer with the names of these nodes.
   Each shard gets at most as many messages as it has open nodes or events.

The driver sees one row per shard (depths and totals).  No key, conversation or prefix, however
common, is a task of its own: turns are numbered by a range sort, prefixes are never grouped, and the ids of
a sequence's members are put together in pieces.

The saved amount of a node is, summed over its subtree, (members - 1) x code points of the node's
last text.  With e(z) conversations that end in z and path(z) code points from the root to z, that is
sum of e(z) * path(z) over the subtree - members * path(parent) - code points in the subtree.

Defined cases: a null role or text is the empty one; rows without conv_id belong to no
conversation; turns go by number (null first), then role, then text digest; repeated rows
are turns of their own; turns are compared by 128-bit digests of role and text.  Without
conversations there are no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.parentheses import Parentheses, RangeMin
from pagewright.operators.ordering import number_rows, ordered_blocks
from pagewright.session import scratch_folder

#: Nodes of a shard, turns that are compared at a time, ids in a piece of a list of members
SHARD, RUN, PIECE = 1 << 16, 16, 4096

_MOST = np.iinfo(np.int64).max


def _written(frame: DataFrame, name: str) -> DataFrame:
    folder = scratch_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), key (digest of role and text), chars and path (chars up to here) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
        F.length(text).cast("long").alias("chars"))
    order = ["conv_id", "turn", "role", "key"]
    blocks = ordered_blocks(turns, [F.asc_nulls_first(c) for c in order], costly=True).selectExpr(
        "*", "sum(chars) OVER (PARTITION BY _block ORDER BY _row) AS _sum")
    # One row per block of the sort; the sums before it are those of the whole table.
    before = "coalesce(sum({}) OVER (ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)".format
    totals = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c")).selectExpr(
        "_block", f"{before('n')} AS rows_before", f"{before('c')} AS chars_before")
    whole = _written(blocks.join(totals, "_block").selectExpr(
        "conv_id", "key", "chars", "rows_before + _row AS number", "chars_before + _sum AS reached"), "turns")
    first = whole.groupBy(F.col("conv_id").alias("of")).agg(F.min("number").alias("first"), F.min(F.expr("reached - chars")).alias("start"))
    return whole.join(first, F.col("conv_id") == F.col("of")).selectExpr(
        "conv_id", "number - first AS place", "key", "chars", "reached - start AS path")


def sequence_numbers(turns: DataFrame, run: int = RUN) -> DataFrame:
    """conv_id and sequence: from 1, in the order of the conversations' sequences of turns; equal ones share it."""
    rows = turns.select("conv_id", "place", F.col("key").alias("name"))
    while True:
        runs = _written(
            rows.groupBy("conv_id", F.expr(f"place DIV {run}").alias("place")).agg(
                F.array_sort(F.collect_list(F.struct(F.expr(f"place % {run}").alias("at"), "name"))).alias("part")).select(
                    "conv_id", "place", F.expr("transform(part, p -> p.name)").alias("part")), "runs")
        names = number_rows(runs.select("part").distinct(), ["part"], "name", costly=True)
        rows = _written(runs.join(names, "part").select("conv_id", "place", "name"), "names")
        longest = rows.agg(F.max("place")).first()[0]
        if not longest:  # one run each, or no turns at all
            return rows.select("conv_id", F.col("name").alias("sequence"))


def member_lists(members: DataFrame) -> DataFrame:
    """sequence, ends (its number of members), least (smallest conv_id) and digest (SHA-256 of the joined ids).

    Ids are joined in pieces in sorted blocks; a digest is taken from piece to piece, so a sequence
    that a third of all conversations share is no group in memory.
    """
    pieces = ordered_blocks(members.select("sequence", "conv_id"), ["sequence", "conv_id"]).groupBy(
        "sequence", "_block", F.expr(f"_row DIV {PIECE}").alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids")).select(
            "sequence", "_block", "piece", F.size("ids").cast("long").alias("ends"), F.col("ids")[0].alias("least"),
            F.expr("array_join(transform(ids, i -> CAST(i AS string)), ',')").alias("joined"))

    def run(batches: Iterator[pa.RecordBatch]):
        sequence, ends, least, digest = None, 0, 0, None
        done: list[tuple] = []

        def flush():
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds)], ["sequence", "ends", "least", "digest"])
            done.clear()
            return out

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("sequence", "ends", "least", "joined"))):
                if row[0] != sequence:
                    if digest is not None:
                        done.append((sequence, ends, least, digest.digest()))
                    sequence, ends, least, digest = row[0], row[1], row[2], hashlib.sha256(row[3].encode())
                else:
                    ends += row[1]
                    digest.update(b"," + row[3].encode())
            if len(done) >= 10_000:
                yield flush()
        if digest is not None:
            done.append((sequence, ends, least, digest.digest()))
        if done:
            yield flush()

    return pieces.repartition("sequence").sortWithinPartitions("sequence", "_block", "piece").mapInArrow(
        run, "sequence long, ends long, least long, digest binary")


def nodes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The trie's nodes in preorder: number (from 0), depth, next_depth (of the following node; 0 at the end),
    chars, path, and ends, least and digest of the conversations that end there (0 and null if none do)."""
    lists = _written(member_lists(members), "members")
    firsts = lists.where("sequence > 0").select(F.col("least").alias("conv_id"), "sequence")
    told = _written(turns.join(firsts, "conv_id").select("sequence", "place", "key", "chars", "path"), "sequences")
    # The shared prefix ends at the first place where the sequence before has another turn, or none.
    earlier = told.select((F.col("sequence") + 1).alias("sequence"), "place", F.col("key").alias("other"))
    shared = _written(
        told.join(earlier, ["sequence", "place"], "left").groupBy("sequence").agg(
            F.min(F.expr("CASE WHEN other IS NULL OR other <> key THEN place END")).alias("shared"), F.max("place").alias("last")), "shared")
    following = shared.select((F.col("sequence") - 1).alias("sequence"), (F.col("shared") + 1).alias("following"))
    spans = shared.join(following, "sequence", "left").select("sequence", "shared", "last", F.coalesce("following", F.lit(0)).alias("following"))
    new = told.join(spans, "sequence").where("place >= shared").selectExpr(
        "sequence", "place + 1 AS depth", "IF(place < last, place + 2, following) AS next_depth", "chars", "path", "place = last AS whole")
    full = new.join(lists.withColumn("whole", F.lit(True)), ["sequence", "whole"], "left").select(
        "sequence", "depth", "next_depth", "chars", "path", F.coalesce("ends", F.lit(0)).alias("ends"), "least", "digest")
    # The root is there if there are conversations, whether or not they have turns.
    root = members.agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("most")).where("n > 0").crossJoin(
        lists.where("sequence = 0").agg(F.max("ends").alias("ends"), F.max("least").alias("least"), F.max("digest").alias("digest"))).selectExpr(
            "0L AS sequence", "0L AS depth", "IF(most > 0, 1L, 0L) AS next_depth", "0L AS chars", "0L AS path", "coalesce(ends, 0L) AS ends", "least", "digest")
    ordered = number_rows(full.unionByName(root), ["sequence", "depth"], "number", costly=True)
    return ordered.withColumn("number", F.col("number") - 1).drop("sequence")


_SHARD_SCHEMA = "shard long, depths array<long>, opens binary, chars array<long>, path array<long>, ends array<long>, least array<long>, digests array<binary>, after long"


def encode(rows: DataFrame, size: int = SHARD) -> DataFrame:
    """One row per shard of `size` nodes: depths of nodes, parentheses (a bit each) and the nodes' values."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        depth, after = (table.column(c).to_numpy() for c in ("depth", "next_depth"))
        before, floor = _floors(depth, after)
        # Parentheses of nodes of earlier shards are no bits: how many close is a matter of depths.
        closing = depth - before + 1 - (after - floor)
        opens = np.zeros(len(depth) + int(closing.sum()), np.uint8)
        opens[np.arange(len(depth)) + np.cumsum(closing) - closing] = 1
        columns = {c: pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("chars", "path", "ends", "least")}
        return pa.table({
            "shard": pa.array([key[0].as_py()]), "depths": pa.array([depth]), "opens": pa.array([np.packbits(opens).tobytes()], pa.binary()),
            **columns, "digests": pa.array([table.column("digest").to_pylist()], pa.list_(pa.binary())), "after": pa.array([int(after[-1])])})

    return rows.withColumn("shard", F.expr(f"number DIV {size}")).groupBy("shard").applyInArrow(run, _SHARD_SCHEMA)


def _floors(depth: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depth below which the path is that of earlier shards, before and after each node."""
    floor = np.minimum(np.minimum.accumulate(after), depth[0])
    return np.concatenate([depth[:1], floor[:-1]]), floor


class Shard:
    """A decoded row with everything that its nodes alone tell."""

    SUMS = ("ends", "leaves", "weight", "chars")

    def __init__(self, row: dict):
        self.number = row["shard"]
        self.depth = np.asarray(row["depths"], np.int64)
        after = np.append(self.depth[1:], row["after"])
        self.before, self.floor = _floors(self.depth, after)
        bits = int((self.depth - self.before + 2 - (after - self.floor)).sum())
        self.trie = Parentheses(np.unpackbits(np.frombuffer(row["opens"], np.uint8))[:bits])
        ends, self.chars, self.path = (np.asarray(row[c], np.int64) for c in ("ends", "chars", "path"))
        self.has = ends > 0
        self.least = np.array([_MOST if x is None else x for x in row["least"]], np.int64)
        self.digests = row["digests"]
        leaf = self.trie.leaf_rank[np.append(self.trie.at[1:], self.trie.size)]
        self.sums = {"ends": np.cumsum(ends), "leaves": leaf, "weight": np.cumsum(ends * self.path), "chars": np.cumsum(self.chars)}
        self.low = int(self.floor[-1])
        #: Depths of the nodes that are open at the end: from `low` up to this one, exclusive
        self.high = int(row["after"])

    def totals(self) -> dict:
        return {k: int(v[-1]) for k, v in self.sums.items()}

    def events(self):
        """Nodes after which depths low to high of earlier shards are closed: (nodes, low, high)."""
        at = np.flatnonzero(self.floor < self.before)
        return at, self.floor[at], self.before[at] - 1

    def outside(self) -> np.ndarray:
        """Nodes whose parents are in earlier shards."""
        return np.flatnonzero((self.depth == self.before) & (self.depth > 0))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_SUMMARY = "shard long, first long, low long, high long, ends long, leaves long, weight long, chars long, least long"
_MESSAGE = "shard long, closing boolean, source long, low long, high long, ends long, leaves long, weight long, chars long, least long"


def spines(summaries: list[dict]) -> dict[int, list[tuple]]:
    """For each shard, (holder, low, high, sums and least of the shards between) of the spines that it closes or adds to.

    Works on one row per shard, like prefix sums over partitions: spines are kept on a stack of
    depth ranges, so there are at most three entries per shard.
    """
    order = sorted(summaries, key=lambda r: r["shard"])
    place = {r["shard"]: i for i, r in enumerate(order)}
    sums = {k: np.concatenate([[0], np.cumsum([r[k] for r in order])]) for k in Shard.SUMS}
    least = RangeMin(np.array([r["least"] for r in order], np.int64))
    stack: list[tuple[int, int, int]] = []
    out: dict[int, list[tuple]] = {}
    for i, row in enumerate(order):
        found = []

        def note(holder: int, low: int, high: int, closing: bool):
            a = place[holder] + 1
            between = {k: int(v[i] - v[a]) for k, v in sums.items()}
            found.append((holder, low, high, closing, between, int(least.of([a], [i])[0]) if a < i else _MOST))

        while stack and stack[-1][2] >= row["low"]:
            holder, low, high = stack.pop()
            note(holder, max(low, row["low"]), high, True)
            if low < row["low"]:
                stack.append((holder, low, row["low"] - 1))
                break
        if stack:
            note(stack[-1][0], stack[-1][1], stack[-1][2], False)  # its parents above what it closes
        out[row["shard"]] = found
        if row["high"] > row["low"]:
            stack.append((row["shard"], row["low"], row["high"] - 1))
    return out


def _send(shard: Shard, pieces: list[tuple]) -> list[tuple]:
    """Messages of a shard: sums that complete spine nodes of earlier ones, and children it has of them."""
    out = []
    at, low, high = shard.events()
    least = np.minimum.accumulate(shard.least)
    parents, children = np.unique(shard.depth[shard.outside()] - 1, return_counts=True)
    for holder, first, last, closing, between, lowest in pieces:
        if closing:
            for k in np.flatnonzero((low <= last) & (high >= first)).tolist():
                n = at[k]
                out.append((holder, True, shard.number, max(int(low[k]), first), min(int(high[k]), last),
                            *[int(shard.sums[s][n]) + between[s] for s in Shard.SUMS], min(int(least[n]), lowest)))
        for k in np.flatnonzero((parents >= first) & (parents <= last)).tolist():
            out.append((holder, False, shard.number, int(parents[k]), int(parents[k]), int(children[k]), 0, 0, 0, 0))
    return out


def _finish(shard: Shard, messages: list[dict]) -> dict[str, np.ndarray]:
    """Members, leaves, saved amount, smallest member and (in this shard) children of every node."""
    n = len(shard.depth)
    close = shard.trie.close()
    here = close >= 0
    end = np.where(here, shard.trie.rank[close], n)  # nodes up to where it closes
    before = {k: np.concatenate([[0], v[:-1]]) for k, v in shard.sums.items()}
    total = {k: v[end - 1] - before[k] for k, v in shard.sums.items()}
    least = RangeMin(shard.least).of(np.arange(n), end)
    parent = shard.trie.parent()
    children = np.bincount(parent[parent >= 0], minlength=n)
    spine = np.flatnonzero(~here)  # by depth, from shard.low
    closings = sorted((m for m in messages if m["closing"]), key=lambda m: m["low"])
    if len(spine) and closings:
        which = np.searchsorted(np.array([m["low"] for m in closings]), shard.depth[spine], "right") - 1
        for k in Shard.SUMS:
            total[k][spine] += np.array([m[k] for m in closings])[which]
        least[spine] = np.minimum(least[spine], np.array([m["least"] for m in closings])[which])
    for m in messages:
        if not m["closing"]:
            children[spine[m["low"] - shard.low]] += m["ends"]
    saved = total["weight"] - total["ends"] * (shard.path - shard.chars) - total["chars"]
    return {"n_convs": total["ends"], "n_leaves": total["leaves"], "saved_tokens": saved, "conv_id": least, "n_children": children, "parent": parent, "spine": spine}


_EMPTY = hashlib.sha256(b"").digest()


def subtrees(shards: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_digest."""
    def summary(batches: Iterator[pa.RecordBatch]):
        rows = []
        for row in _rows(batches):
            s = Shard(row)
            rows.append({"shard": s.number, "first": int(s.depth[0]), "low": s.low, "high": s.high, **s.totals(), "least": int(s.least.min())})
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    spark: SparkSession = shards.sparkSession
    pieces = spark.sparkContext.broadcast(spines([r.asDict() for r in shards.mapInArrow(summary, _SUMMARY).collect()]))

    def send(batches: Iterator[pa.RecordBatch]):
        names = [c.split()[0] for c in _MESSAGE.split(", ")]
        for row in _rows(batches):
            s = Shard(row)
            if rows := _send(s, pieces.value[s.number]):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])

    sent = _written(shards.mapInArrow(send, _MESSAGE), "messages")
    # A shard gets at most a message per spine node and event: bounded by its size and the number of shards.
    got = sent.groupBy(F.col("shard").alias("to")).agg(
        F.collect_list(F.struct("closing", "source", "low", "high", *Shard.SUMS, "least")).alias("messages"))
    informed = shards.join(got, F.col("shard") == F.col("to"), "left").drop("to")

    def answer(batches: Iterator[pa.RecordBatch]):
        for row in _rows(batches):
            s, messages = Shard(row), row["messages"] or []
            asked = [m for m in messages if not m["closing"]]
            if asked:
                done = _finish(s, messages)
                names = done["conv_id"][done["spine"]]
                yield pa.RecordBatch.from_pylist(
                    [{"to": m["source"], "depth": m["low"], "name": int(names[m["low"] - s.low])} for m in asked])

    replies = _written(informed.mapInArrow(answer, "to long, depth long, name long"), "replies").groupBy("to").agg(
        F.collect_list(F.struct("depth", "name")).alias("replies"))

    def finish(batches: Iterator[pa.RecordBatch]):
        for row in _rows(batches):
            s = Shard(row)
            done = _finish(s, row["messages"] or [])
            outside = {r["depth"]: r["name"] for r in row["replies"] or []}
            parents = done["conv_id"][done["parent"]].astype(object)
            for k in s.outside().tolist():
                parents[k] = outside[int(s.depth[k]) - 1]
            parents[s.depth == 0] = None
            yield pa.record_batch([
                pa.array(done["conv_id"]), pa.array(s.depth), pa.array(parents, pa.int64()),
                *[pa.array(done[k]) for k in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                pa.array([_EMPTY if d is None else d for d in s.digests], pa.binary())],
                ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_digest"])

    return informed.join(replies, F.col("shard") == F.col("to"), "left").drop("to").mapInArrow(
        finish, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_digest binary")


def trie(turns: DataFrame, conversations: DataFrame, size: int = SHARD, run: int = RUN) -> DataFrame:
    """The trie's shards, from turns (conv_id, place, key, chars, path) and the conv_ids of all conversations."""
    numbers = sequence_numbers(turns, run)
    members = _written(conversations.select("conv_id").join(numbers, "conv_id", "left").select(
        "conv_id", F.coalesce("sequence", F.lit(0)).alias("sequence")), "members")
    return _written(encode(nodes(turns, members), size), "trie")


def prefix_trie(conversations: DataFrame, size: int = SHARD) -> DataFrame:
    """Nodes of the trie of conversations as they are."""
    turns = _written(numbered_turns(conversations), "numbered")
    return subtrees(trie(turns, turns.select("conv_id").distinct(), size))


#: Turns that a rebuilt conversation takes from another at most, and how far apart such conversations start
SHARED_TURNS, FAMILY = 6, 100


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conv_ids of conversations whose first turns are those of the first of their family.

    Conversation c takes the first crc32(c) mod `SHARED_TURNS` turns of c - c mod `FAMILY` (fewer if there
    are not as many), then its own turns after as many.
    """
    turns = _written(numbered_turns(conversations), "numbered")
    heads = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("place") < SHARED_TURNS - 1, F.struct("place", "key", "chars", "path")))).alias("head"))
    heads = _written(heads, "heads")
    convs = heads.selectExpr("conv_id", "head AS own", f"crc32(CAST(conv_id AS string)) % {SHARED_TURNS} AS taken", f"conv_id - conv_id % {FAMILY} AS base")
    families = _written(
        convs.join(heads.select(F.col("conv_id").alias("base"), "head"), "base", "left").selectExpr(
            "conv_id", "own", "taken", "IF(taken > 0, slice(coalesce(head, array()), 1, CAST(taken AS int)), array()) AS head").selectExpr(
                "conv_id", "taken", "head", "size(head) - taken AS shift",
                "IF(size(head) > 0, element_at(head, -1).path, 0L) - IF(taken > 0, coalesce(try_element_at(own, CAST(taken AS int)).path, 0L), 0L) AS more"),
        "families")
    borrowed = families.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    own = turns.join(families.select("conv_id", "taken", "shift", "more"), "conv_id").where("place >= taken").selectExpr(
        "conv_id", "place + shift AS place", "key", "chars", "path + more AS path")
    return _written(borrowed.unionByName(own), "rebuilt"), families.select("conv_id")


def rebuilt_trie(conversations: DataFrame, size: int = SHARD) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return subtrees(trie(*rebuilt(conversations), size))
