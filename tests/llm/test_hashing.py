import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import hashing

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t☃x. ", max_size=30)), max_size=8)


def grams(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i: i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_split(texts):
    data, offsets = hashing.buffer_of(pa.array(texts, pa.string()))
    begins, ends, owner = hashing.word_spans(data, offsets)
    raw = data.tobytes()
    found = [[] for _ in texts]
    for b, e, o in zip(begins, ends, owner):
        found[o].append(raw[b:e].decode())
    assert found == [(t or "").split() for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_sets_have_the_size_and_equality_of_word_ngrams(texts):
    values, starts = hashing.shingle_sets(pa.array(texts, pa.string()), 5)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:])]
    for a, x in zip(sets, texts):
        assert len(a) == len(grams(x))
        for b, y in zip(sets, texts):
            assert len(a & b) == len(grams(x) & grams(y))


def test_blocks_do_not_change_hashes(monkeypatch):
    text = pa.array([" ".join(f"w{i % 97}" for i in range(2000)), "x" * 5000])
    whole = hashing.shingle_sets(text, 3)
    monkeypatch.setattr(hashing, "_BLOCK", 64)
    cut = hashing.shingle_sets(text, 3)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_slices_cover_all_rows():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["text"])
    parts = list(hashing.slices(batch, "text", limit=12))
    assert sum(p.num_rows for p in parts) == 5
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_bitmap(spark):
    keys = [1, -5, 2**40 + 3, 77]
    bitmap = hashing.bitmap_of(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert hashing.in_bitmap(bitmap, np.array(keys).astype(np.uint64)).all()
    assert not hashing.in_bitmap(bitmap, np.array([2, 99], np.uint64)).any()
