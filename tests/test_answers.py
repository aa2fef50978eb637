"""Model answers that are kept: what is asked, and how often."""

import os
import uuid

import pytest

from pagewright.operators.answers import ask, stored_answers


@pytest.fixture()
def log(tmp_path):
    """A model that writes down every prompt it is asked, from whichever process."""
    folder = str(tmp_path / "calls")
    os.mkdir(folder)

    def model(prompts):
        for p in prompts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write(p)
        return [None if p.startswith("bad") else p.upper() for p in prompts]

    def read():
        return sorted(open(f"{folder}/{name}").read() for name in os.listdir(folder))

    return model, read


def test_equal_prompts_are_asked_once_and_answers_are_kept(spark, tmp_path, log):
    model, read = log
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "bad"), (6, "")], "page_id int, prompt string")
    want = {1: "A", 2: "A", 3: "B", 4: None, 5: None, 6: ""}
    assert {r.page_id: r.answer for r in ask(rows, model, store).collect()} == want
    assert read() == ["", "a", "b", "bad"]
    # The second run makes no call but for what had failed, and for new prompts.
    more = rows.unionByName(spark.createDataFrame([(7, "c")], "page_id int, prompt string"))
    assert {r.page_id: r.answer for r in ask(more, model, store, calls=2).collect()} == want | {7: "C"}
    assert read() == ["", "a", "b", "bad", "bad", "c"]
    assert stored_answers(spark, store).count() == 4


def test_a_model_that_raises_fails_its_batch_only(spark, tmp_path):
    def broken(prompts):
        raise RuntimeError("no")

    rows = spark.createDataFrame([(1, "a")], "page_id int, prompt string")
    store = str(tmp_path / "store")
    assert ask(rows, broken, store).first().answer is None
    assert ask(rows, lambda ps: ["x"] * len(ps), store).first().answer == "x"
    assert ask(rows, broken, store).first().answer == "x"


def test_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "page_id int, prompt string")
    assert ask(rows, lambda ps: ps, str(tmp_path / "store")).collect() == []
