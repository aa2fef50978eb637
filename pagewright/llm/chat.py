"""Tool calls of conversations: linked to results, ordered, checked and written as canonical JSON.

Calls and results are joined by identifier.  The order within a conversation is topological: a
call comes after the results it depends on, a result after its call, and otherwise the given turns
count.  Each event has a place (the latest turn of anything it depends on, and how many steps
within that turn); turns that are in order already are places, and only events that something
out of order leads to are moved, in as many rounds as the longest such chain has steps.  Cycles are
found among the causes of these moves by doubling pointers, after about as many rounds as they are long.
Arguments are parsed and checked against a table of parameters.  Canonical JSON has sorted keys,
no white space and no repeated keys.

Everything is DataFrame expressions and joins.  Numbers within a conversation come from a range
sort and one row per partition and per conversation, so a conversation with a third of all
events is not one task.

Defined cases: a call without a result and a result without a call are kept and not linked.
Rows that repeat an identifier count once: the one with the smallest turn, then text; rows
without one (of a null conversation or turn) are told apart by their values.  Where identifiers
are made up (plain conversations), rows that share one are events of their own; rows equal in
every column that takes part count once, unless `copies` keeps those, too.  Arguments
that are null, no JSON, no object, or name a key twice are invalid as a whole.  Names without
parameters in the table are unknown, which is an error; parameters that the table doesn't list
are errors, too.  Events on a cycle of dependencies are marked and ordered by turn; events that depend
on them, without being on a cycle, come after the latest of them.  A null conversation, turn or text stays null.  Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.ordering import number_within
from pagewright.session import scratch_folder

#: Types of parameters by the parser's names
TYPES = {
    "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<",
}


def _written(frame: DataFrame, name: str) -> DataFrame:
    folder = scratch_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def parameters(spark: SparkSession, tools: dict[str, list[tuple[str, str, bool]]]) -> DataFrame:
    """tool and parameters of each tool, given as (parameter, type, required)."""
    for rows in tools.values():
        if unknown := {kind for _, kind, _ in rows} - TYPES.keys():
            raise ValueError(f"unknown types: {sorted(unknown)}")
    listed = [
        F.struct(F.lit(tool).alias("tool"), F.array(*[
            F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(TYPES[kind]).alias("pattern"), F.lit(needed).alias("needed"))
            for name, kind, needed in rows]).alias("known")) for tool, rows in tools.items()]
    return spark.range(1).select(F.inline(F.array(*listed)))


def validate(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds `arguments_json` (canonical, or null) and `errors` to calls with tool and arguments."""
    parsed = calls.withColumn("parsed", F.expr("try_parse_json(arguments)"))
    fields = "transform(map_entries(try_cast(parsed AS map<string, variant>)), e -> named_struct('name', e.key, 'kind', schema_of_variant(e.value)))"
    checked = parsed.withColumn("found", F.expr(fields)).join(tools, "tool", "left")
    missing = "transform(filter(known, k -> k.needed AND NOT exists(found, f -> f.name = k.name)), k -> concat('missing ', k.name))"
    extra = "transform(filter(found, f -> NOT exists(known, k -> k.name = f.name)), f -> concat('unexpected ', f.name))"
    wrong = ("transform(filter(known, k -> exists(found, f -> f.name = k.name AND NOT rlike(f.kind, k.pattern))), "
             "k -> concat(k.name, ' is no ', k.kind))")
    errors = (f"CASE WHEN known IS NULL THEN array('unknown tool') WHEN found IS NULL THEN array('arguments are no object') "
              f"ELSE array_sort(concat({missing}, {extra}, {wrong})) END")
    return checked.withColumn("errors", F.expr(errors)).withColumn(
        "arguments_json", F.expr("CASE WHEN found IS NOT NULL THEN to_json(parsed) END")).drop("known", "found")


def _loops(causes: DataFrame) -> DataFrame | None:
    """node and head (smallest name of the loop) of the nodes on loops of `causes` (node, to), or None.

    Every node points to one other.  Pointers are doubled: those that lead out of the table go, and after as
    many steps as there are nodes those that are left have arrived on a loop.
    """
    walk, steps, nodes = _written(causes.withColumn("head", F.col("node")), "walk"), 1, None
    while not walk.isEmpty():
        nodes = nodes or walk.count()
        if steps >= nodes:
            return walk.select(F.col("to").alias("node")).distinct().join(walk.select("node", "head"), "node")
        further = walk.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("head").alias("other"))
        walk = _written(walk.join(further, "to").select("node", F.col("next").alias("to"), F.least("head", "other").alias("head")), "walk")
        steps *= 2
    return None


def _raised(start: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """node, anchor and depth after all edges point forward; or the loops that prevent it.

    In each round the events behind an event that moved go after it and remember it as the cause.
    Causes are edges, so a loop of causes is a cycle of edges; and as long as there is none, no depth
    exceeds the number of events, so a cycle shows up.  Loops are looked for after 3, 6, 12, ... rounds.
    """
    placed = start.select("node", "anchor", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("cause"))
    moved, rounds, check = placed, 0, 3
    while True:
        early = moved.select(F.col("node").alias("before"), F.struct("anchor", "depth").alias("early"))
        late = placed.select(F.col("node").alias("after"), F.struct("anchor", "depth").alias("late"))
        wrong = edges.join(early, "before").join(late, "after").where("early >= late")
        moved = _written(
            wrong.groupBy(F.col("after").alias("node")).agg(
                F.max(F.struct("early.anchor", (F.col("early.depth") + 1).alias("depth"), F.col("before").alias("cause"))).alias("to")).select(
                    "node", "to.*"), "moved")
        if moved.isEmpty():
            return placed, None
        placed = _written(
            placed.alias("p").join(moved.alias("m"), "node", "left").select("node", *[
                F.when(F.col("m.depth").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in ("anchor", "depth", "cause")]), "places")
        rounds += 1
        if rounds == check:
            check *= 2
            if (loops := _loops(placed.where("cause IS NOT NULL").select("node", F.col("cause").alias("to")))) is not None:
                return placed, loops


def topological_places(events: DataFrame, edges: DataFrame) -> DataFrame:
    """node, anchor, depth and cyclic of every event, ordered along the edges by (anchor, depth).

    `events` has node and turn, `edges` has before and after.  Nodes on a cycle are marked and stay
    at their own turn; what depends on them comes after the latest of them.  Cycles are
    contracted to one node as they are found, so those that share a node become one in the end.
    """
    start = events.select("node", F.col("turn").alias("anchor"))
    edges = edges.where("before IS NOT NULL AND after IS NOT NULL").select("before", "after")
    groups = None
    while True:
        placed, loops = _raised(start, edges)
        if loops is None:
            break
        loops = _written(loops, "loops")
        head = {end: loops.select(F.col("node").alias(end), F.col("head").alias(f"{end}_head")) for end in ("node", "before", "after", "head")}
        if groups is None:
            groups = loops
        else:
            grown = groups.join(head["head"], "head", "left").select("node", F.coalesce("head_head", "head").alias("head"))
            groups = _written(grown.unionByName(loops.join(groups, "node", "left_anti")), "groups")
        start = _written(start.join(head["node"], "node", "left").groupBy(F.coalesce("node_head", "node").alias("node")).agg(
            F.max("anchor").alias("anchor")), "contracted")
        edges = _written(
            edges.join(head["before"], "before", "left").join(head["after"], "after", "left").select(
                F.coalesce("before_head", "before").alias("before"), F.coalesce("after_head", "after").alias("after")).where(
                    "before <> after").distinct(), "edges")
    placed = placed.select("node", "anchor", "depth")
    if groups is None:
        return placed.withColumn("cyclic", F.lit(False))
    return events.select("node", "turn").join(groups, "node", "left").join(placed, "node", "left").select(
        "node", F.when(F.col("head").isNull(), F.col("anchor")).otherwise(F.col("turn")).alias("anchor"),
        F.when(F.col("head").isNull(), F.col("depth")).otherwise(0).alias("depth"), F.col("head").isNotNull().alias("cyclic"))


def link(calls: DataFrame, results: DataFrame, messages: DataFrame, tools: DataFrame, every: bool = False) -> DataFrame:
    """Ordered events of all conversations.

    `calls` has conv_id, call_id, turn, tool, arguments (JSON) and needs (an array of call_ids
    whose results it depends on); `results` has conv_id, call_id, turn and content; `messages`,
    which are neither, have conv_id, call_id (a name of their own), turn, role and content.  One
    row per event: conv_id, place (from 0 in its conversation), kind, call_id, turn, linked, valid,
    errors, cyclic and json.  With `every`, all rows of an identifier are events: they share its
    place in the order (the smallest turn of them) and go by turn and values there.
    """
    calls = calls.withColumn("call_id", F.coalesce("call_id", F.concat(F.lit("?"), F.hex(F.xxhash64("conv_id", "turn", "tool", "arguments")))))
    results = results.withColumn("call_id", F.coalesce("call_id", F.concat(F.lit("?"), F.hex(F.xxhash64("conv_id", "turn", "content")))))
    if not every:
        calls = calls.groupBy("call_id").agg(F.min(F.struct("turn", "arguments", "conv_id", "tool", "needs")).alias("c")).select("call_id", "c.*")
        results = results.groupBy("call_id").agg(F.min(F.struct("turn", "content", "conv_id")).alias("r")).select("call_id", "r.*")
        messages = messages.groupBy("call_id").agg(F.min(F.struct("turn", "role", "content", "conv_id")).alias("m")).select("call_id", "m.*")
    calls = _written(
        validate(calls.select("conv_id", "call_id", "turn", "tool", "arguments", "needs"), tools).select(
            "conv_id", "call_id", "turn", "tool", "arguments", "arguments_json", "errors", "needs"), "calls")
    results = _written(results.select("conv_id", "call_id", "turn", "content"), "results")
    messages = _written(messages.select("conv_id", "call_id", "turn", "role", "content"), "messages")
    # Nodes are call identifiers with a sign for the kind; rows that share one were combined before they meet.
    call_node, result_node, message_node = (F.concat(F.lit(kind), "call_id") for kind in "crm")
    called, answered, said = (x.groupBy("call_id").agg(F.min("turn").alias("turn")) for x in (calls, results, messages))
    pairs = called.select("call_id", F.lit(True).alias("called")).join(
        answered.select("call_id", F.lit(True).alias("answered")), "call_id", "full").select(
            "call_id", (F.col("called").isNotNull() & F.col("answered").isNotNull()).alias("linked"))
    events = called.select(call_node.alias("node"), "turn").unionAll(answered.select(result_node.alias("node"), "turn")).unionAll(
        said.select(message_node.alias("node"), "turn"))
    edges = called.select(call_node.alias("before"), result_node.alias("after")).unionAll(
        calls.select(F.explode(F.expr("transform(needs, n -> concat('r', n))")).alias("before"), call_node.alias("after")).distinct())
    places = topological_places(events, edges)
    call_json = ("to_json(to_variant_object(named_struct('arguments', try_parse_json(arguments_json), 'errors', errors, "
                 "'id', call_id, 'kind', 'call', 'name', tool)))")
    result_json = "to_json(to_variant_object(named_struct('content', content, 'id', call_id, 'kind', 'result')))"
    message_json = "to_json(to_variant_object(named_struct('content', content, 'id', call_id, 'kind', 'message', 'role', role)))"
    fine = [F.lit(True).alias("valid"), F.expr("CAST(array() AS array<string>)").alias("errors")]
    # Tells rows of one identifier apart in the order.
    value = {"call": F.xxhash64("tool", "arguments"), "result": F.xxhash64("content"), "message": F.xxhash64("role", "content")}
    rows = calls.select(
        "conv_id", F.lit("call").alias("kind"), "call_id", "turn", (F.size("errors") == 0).alias("valid"), "errors",
        F.expr(call_json).alias("json"), call_node.alias("node"), value["call"].alias("value")).unionAll(results.select(
            "conv_id", F.lit("result").alias("kind"), "call_id", "turn", *fine, F.expr(result_json).alias("json"), result_node.alias("node"),
            value["result"].alias("value"))).unionAll(
                messages.select("conv_id", F.lit("message").alias("kind"), "call_id", "turn", *fine, F.expr(message_json).alias("json"),
                                message_node.alias("node"), value["message"].alias("value")))
    linked = F.coalesce(F.col("linked") & (F.col("kind") != "message"), F.lit(False))
    joined = rows.join(pairs, "call_id", "left").withColumn("linked", linked).join(places, "node")
    ordered = number_within(joined.drop("node"), "conv_id", ["anchor", "depth", "kind", "call_id", "turn", "value"], "place")
    return ordered.select("conv_id", "place", "kind", "call_id", "turn", "linked", "valid", "errors", "cyclic", "json")


#: What every user turn of a plain conversation is read as a call of
TOOLS = {"reply": [("text", "string", True), ("turn", "integer", True), ("after", "string", False)]}


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and messages of plain conversations.

    A user turn is a call of `reply` that depends on the answer to the turn two before it; an
    assistant turn is the result of the call one turn before; all other turns are messages.
    """
    def identifier(back: int) -> str:
        return f"coalesce(concat(conv_id, ':', turn - {back}), concat('?', hex(xxhash64(conv_id, turn, role, text))))"

    turns = conversations.select("conv_id", "turn", "role", "text")
    calls = turns.where("role = 'user'").selectExpr(
        "conv_id", f"{identifier(0)} AS call_id", "turn", "'reply' AS tool",
        f"to_json(named_struct('text', text, 'turn', turn, 'after', IF(turn >= 2, {identifier(2)}, NULL))) AS arguments",
        f"IF(turn >= 2, array({identifier(2)}), CAST(array() AS array<string>)) AS needs")
    results = turns.where("role = 'assistant'").selectExpr("conv_id", f"{identifier(1)} AS call_id", "turn", "text AS content")
    messages = turns.where("role IS NULL OR role NOT IN ('user', 'assistant')").selectExpr(
        "conv_id", f"{identifier(0)} AS call_id", "turn", "role", "text AS content")
    return calls, results, messages


def linked_conversations(conversations: DataFrame, copies: bool = False) -> DataFrame:
    """The ordered events of plain conversations: one per row, or per distinct row without `copies`."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    return link(*from_conversations(turns if copies else turns.distinct()), parameters(conversations.sparkSession, TOOLS), every=True)
