import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pagewright.llm import prefix_trie
from pagewright.llm.parentheses import Parentheses, RangeMin

SCHEMA = "conv_id long, turn long, role string, text string, depth long, number long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 3, 4) for r in rows], SCHEMA)


def sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: tuple((r, x) for _, r, x in sorted(turns)) for c, turns in own.items()}


def by_families(plain):
    out = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = plain.get(base, ())[:h] + turns[h:]
    return out


def by_prefixes(found):
    members, below = defaultdict(list), defaultdict(list)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = sum(saved[k] for k in below[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(found[c]) == len(p)).encode()).digest())
        for p, m in members.items()}


def as_set(frame):
    rows = [(*r[:7], bytes(r[7])) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(seed):
    draw, rows = random.Random(seed), []
    for i in range(60):
        c = draw.choice([i, i + 100, i + 200, -i])
        for t in range(draw.choice([0, 1, 2, 3, 6, 9, 25])):
            rows.append((c, t * 1000 + len(rows), draw.choice(["u", None, "a"]), draw.choice(["x", "yy", None, "", "é"])))
    return rows


@pytest.mark.parametrize("size,run", [(1, 2), (7, 3), (1000, 16)])
def test_rebuilt_conversations_against_prefix_sets(spark, size, run):
    rows = random_rows(size)
    got = prefix_trie.subtrees(prefix_trie.trie(*prefix_trie.rebuilt(table(spark, rows)), size, run))
    assert as_set(got) == by_prefixes(by_families(sequences(rows)))


def test_long_equal_and_nested_conversations_over_many_shards(spark):
    rows = [(7, t, "u", "abc") for t in range(100)] + [(8, t, "u", "abc") for t in range(99)] + [(9, t, "u", "abc") for t in range(50)]
    rows += [(c, t, "u", "abc" if t < c else f"{c}") for c in range(20, 50) for t in range(c + 2)]
    rows += [(10, t, "u", "abc") for t in range(100)]  # a copy of 7
    assert as_set(prefix_trie.prefix_trie(table(spark, rows), 8)) == by_prefixes(sequences(rows))


def test_odd_rows(spark):
    rows = [(None, 1, "u", "lost"), (1, None, None, "first"), (1, 0, "u", None), (1, 0, "u", None), (2, None, "", "first"), (2, 5, "u", ""),
            (3, 1, "u", "x"), (4, 1, None, "ux"), (5, 2, "u", "x" * 100_000), (6, 9, "u", "x" * 100_000)]
    assert as_set(prefix_trie.prefix_trie(table(spark, rows))) == by_prefixes(sequences(rows))
    # Every conversation of this one loses all its turns to an absent one.
    rows = [(c, 0, "u", f"{c}") for c in range(501, 540) if zlib.crc32(str(c).encode()) % 6]
    assert as_set(prefix_trie.rebuilt_trie(table(spark, rows))) == by_prefixes(by_families(sequences(rows)))
    assert prefix_trie.rebuilt_trie(table(spark, [])).count() == 0
    assert prefix_trie.rebuilt_trie(table(spark, [(None, 1, "u", "x")])).count() == 0


def test_members_of_a_common_sequence_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    members = spark.createDataFrame([(c % 3, c) for c in range(-20, 80)], "sequence long, conv_id long")
    for r in prefix_trie.member_lists(members).collect():
        ids = [c for c in range(-20, 80) if c % 3 == r["sequence"]]
        assert (r["ends"], r["least"]) == (len(ids), ids[0])
        assert bytes(r["digest"]) == hashlib.sha256(",".join(map(str, ids)).encode()).digest()


def test_parentheses_against_a_stack():
    draw = random.Random(2)
    for _ in range(150):
        n, up = draw.choice([1, 2, 5, 50, 300, 2000]), draw.choice([0.3, 0.5, 0.6, 0.9])
        bits, stack, nodes = [], [], 0
        while nodes < n:
            if stack and draw.random() > up:
                bits.append(0)
                stack.pop()
            else:
                bits.append(1)
                stack.append(nodes)
                nodes += 1
        bits += [0] * draw.randint(0, len(stack))
        stack, close, parent, k = [], [-1] * n, [], 0
        for i, bit in enumerate(bits):
            if bit:
                parent.append(stack[-1] if stack else -1)
                stack.append(k)
                k += 1
            else:
                close[stack.pop()] = i
        trie = Parentheses(np.array(bits, np.uint8))
        assert trie.close().tolist() == close and trie.parent().tolist() == parent


def test_range_minima():
    values, draw = np.random.default_rng(1).integers(0, 99, 500), random.Random(1)
    begin = [draw.randrange(500) for _ in range(200)]
    end = [draw.randint(b + 1, 500) for b in begin]
    assert RangeMin(values).of(begin, end).tolist() == [values[a:b].min() for a, b in zip(begin, end)]
