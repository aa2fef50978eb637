import random

from pagewright.llm import tiling

random.seed(8)


def words(n):
    return [f"w{random.randint(0, 3000)}" for _ in range(n)]


def slow_tiles(text, item, least=tiling.SEED):
    """Greedy string tiling as it is defined: longest free match first, then smallest places."""
    in_text, in_item = [False] * len(text), [False] * len(item)
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and not in_item[i + k] and not in_text[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, t)
        if best[0] < least:
            return sum(in_item)
        for k in range(best[0]):
            in_item[best[1] + k] = in_text[best[2] + k] = True


def pairs(text, item, seed=tiling.SEED):
    return [(t, i) for i in range(len(item) - seed + 1) for t in range(len(text) - seed + 1) if item[i: i + seed] == text[t: t + seed]]


def test_tiles_equal_brute_force():
    for trial in range(150):
        item = [random.choice("abcdef"[: 2 + trial % 5]) for _ in range(random.randint(1, 25))]
        text = []
        for _ in range(4):
            a = random.randint(0, len(item))
            text += item[a: a + random.randint(0, 12)] + random.choices("abcxyz", k=random.randint(0, 4))
        assert tiling.tile(pairs(text, item))[0] == slow_tiles(text, item)


def contaminated(frame):
    return {r.doc_id: (r.contaminated, r.item_id) for r in frame.collect()}


def test_whole_reordered_and_partial_passages(spark, documents):
    items = [words(40) for _ in range(12)]
    benchmark = spark.createDataFrame([(i, " ".join(w), 5) for i, w in enumerate(items)] + [(90, None, 1), (91, "", 1), (92, "a b", 1), (None, "x", 1)],
                                      "item_id long, text string, doc_id int")
    reordered = items[3][20:] + items[3][:20]
    texts = [
        " ".join(words(50) + items[2] + words(50)), " ".join(words(9) + reordered), " ".join(words(30) + items[4][:9] + words(30)),
        " ".join(items[5][5:20]).upper().replace(" ", ", "), " ".join(words(400)), None, "", "a b", " ".join(items[7] * 300),
    ]
    docs = documents(texts)
    expected = {0: (True, 2), 1: (True, 3), 2: (False, None), 3: (True, 5), 4: (False, None), 5: (False, None), 6: (False, None),
                7: (False, None), 8: (True, 7)}
    assert contaminated(tiling.contamination(docs, benchmark)) == expected
    # Chunks of a few items give the same.
    assert contaminated(tiling.contamination(docs, benchmark, chunk=100)) == expected
    for chunk in (tiling.CHUNK, 100):
        kept = tiling.decontaminate(docs, benchmark, chunk=chunk)
        assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7]


def test_a_common_phrase_in_a_short_item_is_not_enough(spark, documents):
    benchmark = spark.createDataFrame([(1, "which of the following is right now here"), (2, "all these six words are here")], "item_id long, text string")
    docs = documents(["so which of the following is best", "x all these six words are here y", "which of the following is right now here"])
    assert contaminated(tiling.contamination(docs, benchmark)) == {0: (False, None), 1: (True, 2), 2: (True, 1)}


def test_ties_go_to_the_smallest_item_and_empty_tables(spark, documents):
    passage = " ".join(words(20))
    benchmark = spark.createDataFrame([(9, passage), (4, passage), (4, passage)], "item_id long, text string")
    docs = documents([passage, passage], [1, 1])
    assert [(r.item_id, r.coverage) for r in tiling.contamination(docs, benchmark).collect()] == [(4, 1.0)] * 2
    assert contaminated(tiling.contamination(docs, benchmark.limit(0))) == {1: (False, None)}
    assert tiling.contamination(documents([]), benchmark).collect() == []


def test_items_without_id_take_part(spark, documents):
    one, two = words(40), words(40)
    benchmark = spark.createDataFrame([(None, " ".join(one)), (None, " ".join(two)), (8, " ".join(two)), (None, None)], "item_id long, text string")
    docs = documents([" ".join(words(20) + one), " ".join(two + words(20)), " ".join(words(80)), None])
    for chunk in (tiling.CHUNK, 40):
        assert contaminated(tiling.contamination(docs, benchmark, chunk=chunk)) == {0: (True, None), 1: (True, 8), 2: (False, None), 3: (False, None)}
        assert sorted(r.doc_id for r in tiling.decontaminate(docs, benchmark, chunk=chunk).collect()) == [2, 3]


def test_a_long_tile_counts_however_long_the_item(spark, documents):
    item = words(400)
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = documents([" ".join(words(30) + item[200:310] + words(30)), " ".join(words(30) + item[200:249]), " ".join(item[200:250])])
    rows = {r.doc_id: r for r in tiling.contamination(docs, benchmark).collect()}
    assert [rows[i].contaminated for i in range(3)] == [True, False, True]
    assert rows[0].coverage == 110 / 400


def test_a_passage_that_many_texts_and_items_share(spark, documents, monkeypatch):
    passage = words(30)
    items = [words(20) + passage + words(15) for _ in range(60)]
    texts = [words(40) + passage + words(25) for _ in range(60)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = documents([" ".join(w) for w in texts])
    calls = []
    real = tiling.tile
    table = next(tiling.tables(benchmark))
    monkeypatch.setattr(tiling, "tile", lambda pairs: calls.append(1) or real(pairs))
    column = docs.select("text").toArrow().column("text").combine_chunks()
    found = tiling.matches(column, table)
    assert len(calls) < 60 and len(found) == 60
    # Few matches at a time give the same.
    monkeypatch.setattr(tiling, "HITS", 50)
    assert tiling.matches(column, table) == found
    # A neighbour may be the same word by chance.
    assert all(30 / 65 <= share <= 32 / 65 for share, _ in found.values())
