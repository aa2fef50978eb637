import json
import random

import duckdb

from pagewright.llm import chat, queries
from pagewright.llm.reference_sql import ORACLE

CALL = "conv_id long, call_id string, turn long, tool string, arguments string, needs array<string>, place int, json string"
RESULT = "conv_id long, call_id string, turn long, content string, linked int"
MESSAGE = "conv_id long, call_id string, turn long, role string, content string"
TOOLS = {"f": [("x", "integer", True), ("y", "string", False), ("n", "number", False)], "g": []}


def linked(spark, calls, results, messages=()):
    return chat.link(
        spark.createDataFrame([(*c, 0, "") for c in calls], CALL), spark.createDataFrame([(*r, 0) for r in results], RESULT),
        spark.createDataFrame(list(messages), MESSAGE), chat.parameters(spark, TOOLS)).collect()


def order(rows, conversation):
    rows = sorted((r for r in rows if r.conv_id == conversation), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(len(rows)))
    return [r.kind[0] + r.call_id for r in rows]


def test_results_follow_calls_and_calls_follow_what_they_need(spark):
    calls = [(1, "a", 5, "f", '{"x":1}', ["b"]), (1, "b", 6, "f", '{"x":2}', []), (1, "d", 9, "f", '{"x":3}', ["a", "b"]),
             (2, "p", 1, "g", "{}", None), (2, "q", 2, "g", "{}", ["p"])]
    results = [(1, "a", 4, "ra"), (1, "b", 7, "rb"), (2, "p", 3, "rp"), (2, "z", 0, "orphan")]
    rows = linked(spark, calls, results, [(1, "s", 0, "system", "hi")])
    assert order(rows, 1) == ["ms", "cb", "rb", "ca", "ra", "cd"]
    assert order(rows, 2) == ["rz", "cp", "rp", "cq"]
    assert {r.kind[0] + r.call_id for r in rows if r.linked} == {"ca", "ra", "cb", "rb", "cp", "rp"}
    assert not any(r.cyclic for r in rows)


def test_long_chain_against_the_turns_and_cycles(spark):
    calls = [(1, f"k{i:02}", 40 - i, "g", "{}", [f"k{i - 1:02}"] if i else []) for i in range(12)]
    results = [(1, f"k{i:02}", 100 if i == 0 else 0, "") for i in range(12)]
    rows = linked(spark, calls, results)
    assert order(rows, 1) == [x for i in range(12) for x in (f"ck{i:02}", f"rk{i:02}")]
    rows = linked(spark, [(1, "a", 1, "g", "{}", ["b"]), (1, "b", 2, "g", "{}", ["a"]), (1, "c", 3, "g", "{}", [])],
                  [(1, "a", 1, ""), (1, "b", 2, "")])
    assert len(rows) == 5 and any(r.cyclic for r in rows) and not next(r for r in rows if r.call_id == "c").cyclic


def test_arguments_are_checked_and_canonical(spark):
    given = {
        "ok": ("f", ' {"y" : "é\\n", "x": 7, "n": 1.5} '), "types": ("f", '{"x":"7","y":1,"n":[]}'), "missing": ("f", '{"y":"a","q":1}'),
        "float": ("f", '{"x":1.5}'), "list": ("f", "[1]"), "broken": ("f", '{"x":'), "twice": ("f", '{"x":1,"x":2}'), "null": ("f", None),
        "unknown": ("h", "{}"), "nested": ("g", '{"b":{"z":1,"a":[{"d":1,"c":2}]}}'),
    }
    rows = linked(spark, [(1, k, i, *v, []) for i, (k, v) in enumerate(given.items())], [])
    errors = {r.call_id: r.errors for r in rows}
    assert errors == {
        "ok": [], "types": ["n is no number", "x is no integer", "y is no string"], "missing": ["missing x", "unexpected q"],
        "float": ["x is no integer"], "list": ["arguments are no object"], "broken": ["arguments are no object"],
        "twice": ["arguments are no object"], "null": ["arguments are no object"], "unknown": ["unknown tool"], "nested": ["unexpected b"]}
    assert all(r.valid == (not r.errors) for r in rows)
    for r in rows:
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    by = {r.call_id: json.loads(r.json) for r in rows}
    assert by["ok"]["arguments"] == {"y": "é\n", "x": 7, "n": 1.5} and by["list"]["arguments"] is None


def test_repeats_nulls_and_empty_tables(spark):
    rows = linked(spark, [(1, "a", 3, "g", "{}", []), (1, "a", 2, "g", "{}", []), (None, "n", None, None, None, None), (None, None, None, None, "{}", [])],
                  [(1, "a", 4, None), (1, "a", 4, "x" * 100_000)])
    assert sorted((str(r.call_id)[:1], r.kind) for r in rows) == [("?", "call"), ("a", "call"), ("a", "result"), ("n", "call")]
    assert next(r for r in rows if r.call_id == "a" and r.kind == "call").turn == 2
    assert linked(spark, [], []) == []


def test_plain_conversations(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "user", None), (2, 0, "user", "a"),
             (2, 1, "user", "b"), (2, 2, "assistant", "c"), (None, 1, "user", "lost"), (3, None, "assistant", "lost"), (4, 0, None, "odd"), (4, 0, None, "odd")]
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, place int")
    rows = chat.linked_conversations(frame).collect()
    assert order(rows, 1) == ["m1:0", "c1:1", "r1:1", "c1:3"]
    assert {r.call_id: (r.linked, r.errors) for r in rows if r.kind == "call" and r.conv_id} == {
        "1:1": (True, []), "1:3": (False, ["missing text"]), "2:0": (False, []), "2:1": (True, [])}
    assert len(rows) == 10
    assert chat.linked_conversations(frame.limit(0)).collect() == []


def test_no_python_on_the_way(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    plan = chat.linked_conversations(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_every_row_of_a_repeated_turn_is_an_event(spark, tmp_path):
    turns = [(7, t, role, f"{role} {t} {i}") for t in (0, 1, 2, 5) for i in range(9) for role in ("system", "user", "assistant")]
    turns += [(7, 3, "user", "same")] * 4 + [(7, 4, "assistant", "same")] * 3 + [(8, 0, "user", "a"), (8, 1, "assistant", "b"), (8, 1, "assistant", "c")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    ours = queries.op7_chat(spark, str(tmp_path)).collect()
    cursor = duckdb.connect().execute(ORACLE["op7_chat"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'"))
    names = [c[0] for c in cursor.description]
    theirs = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert len(ours) == len(theirs) == len(turns)

    # Rows that share turn, kind and identifier have no order among each other in the SQL.
    def plain(rows, columns):
        return sorted(tuple(r[c] for c in columns) for r in rows)

    for columns in (["conv_id", "place", "kind", "call_id", "turn", "linked"], [c for c in names if c != "place"]):
        assert plain(ours, columns) == plain(theirs, columns)
    assert chat.linked_conversations(frame).count() == len(set(turns))


def by_hand(turns, edges):
    """Places by the definition: cycles by reachability, then raising until nothing changes."""
    after = {n: {b for a, b in edges if a == n} for n in turns}
    reach = {}
    for n in turns:
        seen, todo = set(), [n]
        while todo:
            for m in after[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        reach[n] = seen
    cyclic = {n for n in turns if n in reach[n]}
    head = {n: min({n} | {m for m in reach[n] if n in reach[m]}) for n in turns}
    places = {}
    for n in turns:
        places[head[n]] = max(places.get(head[n], (-1, 0)), (turns[n], 0))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if head[a] != head[b] and places[head[a]] >= places[head[b]]:
                places[head[b]], changed = (places[head[a]][0], places[head[a]][1] + 1), True
    return {n: (turns[n], 0, True) if n in cyclic else (*places[n], False) for n in turns}


def test_places_against_the_definition(spark):
    # Several graphs in one table: nodes of different graphs have no edges between them.
    draw = random.Random(3)
    turns, edges = {}, []
    for graph in range(40):
        nodes = [f"{graph}-{i:02}" for i in range(draw.randint(1, 14))]
        turns.update({n: draw.randint(0, 8) for n in nodes})
        edges += [(draw.choice(nodes), draw.choice(nodes)) for _ in range(draw.randint(0, len(nodes) + 4))]
    # A ring, a ring with an ear and what hangs on them.
    turns |= {f"ring{i:02}": i for i in range(30)}
    edges += [(f"ring{i:02}", f"ring{(i + 1) % 30:02}") for i in range(30)] + [("ring20", "ear"), ("ear", "ring03"), ("ear", "tail"), ("0-00", "ear")]
    turns |= {"ear": 1, "tail": 2}
    found = chat.topological_places(
        spark.createDataFrame(list(turns.items()), "node string, turn long"),
        spark.createDataFrame([*edges, (None, "tail"), ("tail", None)], "before string, after string")).collect()
    want = by_hand(turns, set(edges))
    assert {r.node: (r.anchor, r.depth, r.cyclic) for r in found} == want
    assert len(found) == len(want) and sum(c for _, _, c in want.values()) > 40 and want["tail"] == (29, 1, False)


def test_a_cycle_among_many_events_takes_few_rounds(spark, monkeypatch):
    tables = []
    write = chat._written
    monkeypatch.setattr(chat, "_written", lambda frame, name: tables.append(name) or write(frame, name))
    # One long chain of calls and results in order; two calls in its middle need each other.
    events = spark.range(100_000).selectExpr("concat(IF(id % 2 = 0, 'c', 'r'), id DIV 2) AS node", "id AS turn")
    edges = spark.range(99_999).selectExpr(
        "concat(IF(id % 2 = 0, 'c', 'r'), id DIV 2) AS before", "concat(IF(id % 2 = 1, 'c', 'r'), (id + 1) DIV 2) AS after")
    both = edges.unionAll(spark.createDataFrame([("r25001", "c25000")], "before string, after string"))
    found = chat.topological_places(events, both)
    assert sorted(r.node for r in found.where("cyclic").collect()) == ["c25000", "c25001", "r25000", "r25001"]
    assert found.where("NOT cyclic AND (depth > 0 OR anchor <> int(substr(node, 2)) * 2 + int(substr(node, 1, 1) = 'r'))").count() == 0
    assert found.count() == 100_000 and tables.count("moved") + tables.count("walk") < 20
