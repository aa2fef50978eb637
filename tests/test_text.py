"""Text expressions against Python."""

import random

from pagewright.functions import text as X


def test_rounding_equals_python(spark):
    rnd = random.Random(4)
    values = [rnd.choice([rnd.random() * 10, rnd.randint(0, 4000) / 20, rnd.randint(0, 100000) / 8,
                          rnd.randint(0, 1000) / 100, rnd.random() * 1e7]) for _ in range(5000)]
    rows = spark.createDataFrame([(v, f"{v:.0f}", f"{v:.1f}") for v in values], "v double, whole string, tenth string")
    assert rows.filter(f"{X.fixed_decimals('v', 0)} <> whole or {X.fixed_decimals('v', 1)} <> tenth").count() == 0


def test_durations(spark):
    rows = spark.createDataFrame([(0.5,), (59.94,), (60.0,), (90.0,), (3599.0,), (3600.0,), (9000.0,)], "s double")
    found = [tuple(r) for r in rows.selectExpr(X.duration_text("s"), X.duration_text_1("s")).collect()]
    assert found == [
        ("0 seconds", "0.5 seconds"), ("60 seconds", "59.9 seconds"), ("1 minutes", "1.0 minutes"),
        ("2 minutes", "1.5 minutes"), ("60 minutes", "60.0 minutes"), ("1.0 hours", "1.0 hours"),
        ("2.5 hours", "2.5 hours")]


def test_anchor(spark):
    rows = spark.createDataFrame([("Hello, World!",), ("--",), ("Ünï  x" + "y" * 40,), ("a_b-c",)], "t string")
    assert [r[0] for r in rows.selectExpr(X.page_anchor("t", "7")).collect()] == [
        "page-7-hello-world", "page-7", "page-7-ünï-x" + "y" * 25, "page-7-a-b-c"]


def test_truncation(spark):
    rows = spark.createDataFrame([("é" * 300,), ("short",)], "t string")
    found = rows.selectExpr(X.for_model("t", 200), X.for_export("t", 10), X.short_summary("t", 5)).collect()
    assert tuple(found[0]) == ("é" * 100 + "\n\n[Content truncated...]", "é" * 10 + "\n\n*[Content truncated...]*",
                               "é" * 5 + "...")
    assert tuple(found[1]) == ("short", "short", "short")
