import random

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import hashing, periodic
from pagewright.llm.queries import looped


def by_definition(words, least, times):
    n, shortest = len(words), {}
    for p in range(1, n // times + 1):
        j = p
        while j < n:
            begin = j
            while j < n and words[j] == words[j - p]:
                j += 1
            if j > begin and j - begin + p >= max(least, times * p):
                shortest.setdefault((begin - p, j - begin + p), p)
            j += 1
    return sorted(((s, size, p) for (s, size), p in shortest.items()), key=lambda r: (r[0], r[2]))


def over_all_earlier_occurrences(words, least, times):
    """The search of the module's title without its pruning: every earlier occurrence counts."""
    active, seen, found = {}, {}, {}
    for j, word in enumerate([*words, None]):
        following = {j - i: active.pop(j - i, 0) + 1 for i in seen.get(word, [])}
        for lag, length in active.items():
            if length + lag >= max(least, times * lag):
                key = (j - length - lag, length + lag)
                found[key] = min(lag, found.get(key, lag))
        active = following
        seen.setdefault(word, []).append(j)
    return sorted(((s, size, p) for (s, size), p in found.items()), key=lambda r: (r[0], r[2]))


def hashes(words):
    return hashing.mix(np.array(words, dtype=np.uint64) + np.uint64(11))


@pytest.mark.parametrize("least,times", [(1, 3), (5, 3), (8, 4), (24, 3)])
def test_runs_are_those_of_the_definition(least, times):
    draw, found = random.Random(least * 10 + times), 0
    for _ in range(400):
        n, letters = draw.randint(0, 120), draw.choice([1, 2, 3, 5])
        words = [draw.randrange(letters) for _ in range(n)]
        if n > 30 and draw.random() < 0.7:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randint(3, 9)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        want = by_definition(words, least, times)
        found += len(want)
        assert periodic.runs_of(hashes(words), least, times) == want == over_all_earlier_occurrences(words, least, times)
    assert found > 50


def test_one_word_over_and_over_is_cheap():
    assert periodic.runs_of(hashes([3] * 50_000)) == [(0, 50_000, 1)]


def test_long_period_and_nested_runs():
    part = [1] * 30 + list(range(2, 900)) + [5]
    words = part * 4
    got = periodic.runs_of(hashes(words))
    assert got == by_definition(words, 24, 3)
    assert (0, len(words), len(part)) in got and (0, 30, 1) in got
    assert periodic.strongest(got) == (0, 30, 1)


def test_too_few_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.least_context(24, 2)


def test_table(documents):
    texts = [None, "", " \n\t", "a b c", "x " * 30, " ".join(["one two", "three"] * 12) + "  end", "é ü " * 40, "x " * 30, "tab\tand\x0bother " * 20 + "stop"]
    rows = {r["doc_id"]: r for r in periodic.periodic_runs(documents(texts, [0, 1, 2, 3, 4, 5, 6, 4, None])).collect() if r["doc_id"] != 4}
    assert [rows[i]["n_words"] for i in (0, 1, 2, 3)] == [0, 0, 0, 3]
    assert all(rows[i]["runs"] == [] and rows[i]["strongest"] is None for i in (0, 1, 2, 3))
    assert [rows[i]["collapsed"] for i in (0, 1, 2, 3)] == ["", "", "", "a b c"]
    assert [tuple(r) for r in rows[5]["runs"]] == [(0, 36, 3)] and rows[5]["collapsed"] == "one two three end"
    assert tuple(rows[6]["strongest"]) == (0, 40, 1) and rows[6]["collapsed"] == "é ü"
    assert rows[None]["collapsed"] == "tab and other stop"


def test_repeated_rows_and_empty_table(documents):
    rows = periodic.periodic_runs(documents(["x " * 30] * 3, [4, 4, 4])).collect()
    assert [(r["doc_id"], r["collapsed"]) for r in rows] == [(4, "x")] * 3
    assert periodic.periodic_runs(documents([])).count() == 0


def test_texts_of_a_batch_do_not_touch():
    sizes, runs, collapsed = periodic.search(pa.array(["a " * 20 + "a", "a", "", None, "b", "a " * 24]))
    assert sizes.tolist() == [21, 1, 0, 0, 1, 24]
    assert [len(r) for r in runs] == [0, 0, 0, 0, 0, 1]
    assert collapsed.to_pylist() == [" ".join(["a"] * 21), "a", "", "", "b", "a"]


def test_looped_words(documents):
    import zlib

    texts = {i: " ".join(f"w{k}" for k in range(i * 7)) for i in range(80)}
    got = {r["doc_id"]: r["text"] for r in looped(documents(list(texts.values()), list(texts))).collect()}
    changed = 0
    for i, text in texts.items():
        words, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
            changed += words != text.split()
        assert got[i].split() == words
    assert changed
