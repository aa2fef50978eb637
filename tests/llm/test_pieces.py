import itertools
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return pieces.Encoder(vocabulary)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(encoder, texts):
    ids, starts = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]


ODD = ["", " ", "   ", "a", " a  b\n c\t▁x é☃ ", "\n", "the.\nEdin", "x" * 3000, " " * 500 + "a" + " " * 33, "日本語 のテスト", "🙂🙂 ok",
       "\x00a\x01 b", "▁▁ ▁", "  é", "<s> </s><0x0A>", "\r\n", "é ﬁ"]


def test_ids_are_those_of_the_public_encoder(encoder, library):
    assert ids_of(encoder, ODD) == [library.encode(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("theinoras  \n.▁"), st.characters(codec="utf-8")), max_size=60), max_size=6))
def test_any_text(encoder, library, texts):
    assert ids_of(encoder, texts) == [library.encode(t) for t in texts]


def test_decoding_gives_the_text_back(spark, documents, vocabulary, library):
    texts = [*ODD, None, "the end " * 5000]
    docs = documents([*texts, "a", "a"], [*range(len(texts)), 0, None])
    encoded = pieces.encode(docs, vocabulary)
    rows = encoded.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None or r.doc_id == 0:
            continue
        text = texts[r.doc_id]
        assert (r.ids, r.round_trip) == ((None, None) if text is None else (library.encode(text), True))
        assert r.n_tokens == (None if text is None else len(r.ids))
    back = {r.doc_id: r.text for r in pieces.decode(encoded.where("doc_id > 0"), vocabulary).collect()}
    assert back == {i: None if t is None else t.replace("▁", " ") for i, t in enumerate(texts) if i}
    assert pieces.encode(documents([]), vocabulary).collect() == []


def test_best_path_of_a_unigram_vocabulary():
    rows = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]]
    scores = {"▁": -2.0, "a": -3.0, "b": -3.1, "ab": -5.0, "▁a": -4.1, "ba": -4.0, "bab": -8.3, "▁ab": -7.9}
    v = pieces.Vocabulary.of(rows + [(p, s, 1) for p, s in scores.items()], merges=False)
    lattice = pieces.Lattice(v)

    def best(word):
        found = []
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for k, cut in enumerate([*cuts, 1], 1):
                if cut:
                    parts.append(word[at:k])
                    at = k
            if all(p in scores for p in parts):
                found.append(sum(scores[p] for p in parts))
        return max(found)

    random.seed(1)
    for word in sorted({"".join(random.choices("ab", k=random.randint(1, 7))) for _ in range(60)}):
        assert sum(v.scores[i] for i in lattice.encode(1, word)) == pytest.approx(best("▁" + word))


def test_cache_and_order_do_not_matter(vocabulary, encoder):
    texts = [f"word{i} the{i % 7}" for i in range(300)]
    fresh = pieces.Encoder(vocabulary)
    assert ids_of(encoder, texts) == [ids_of(fresh, [t])[0] for t in reversed(texts)][::-1]
