"""Entity decoding by expressions against the standard library."""

import random
from html import unescape
from html.entities import html5

from pagewright.functions.entities import unescape_html
from pagewright.operators import content as C


def decoded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").selectExpr("i", f"{unescape_html('t')} AS u")
    return [r.u for r in sorted(rows.collect(), key=lambda r: r.i)]


def test_every_name_and_its_beginnings(spark):
    texts = [f"a&{n}b" for n in html5] + [f"&{n[:-1]}" for n in html5] + [f"&{n}x;" for n in html5 if not n.endswith(";")]
    assert decoded(spark, texts) == [unescape(t) for t in texts]


def test_numbers(spark):
    codes = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0x1F600, 0x10FFFD, 0x10FFFE, 0x110000, 1 << 40]
    texts = [f"x&#{n};y" for n in codes] + [f"&#x{n:x}z" for n in codes] + [f"&#X{n:X};;" for n in codes]
    texts += ["&#0000000000000000065;", "&#x00000000000000041", "&#;", "&#x;", "&#xg", "&#1114112", "&#" + "9" * 100 + ";"]
    assert decoded(spark, texts) == [unescape(t) for t in texts]


def test_random_texts(spark):
    draw = random.Random(12)
    parts = ["&", "&amp", "&amp;", "&lt", "&notit;", "&notin;", "&#38;", "&#x26", ";", "#", "x", "é", "😀", " ", "\n", "<", "&" + "a" * 40, "&zz;", "not", "copy", "&copy", "T"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(3000)] + ["", None, "&", "&&amp;&"]
    assert decoded(spark, texts) == [t if t is None else unescape(t) for t in texts]


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([("<p>a &lt; b</p>",)], "html string").select(C.strip_tags("html").alias("text"))
    assert "Python" not in rows._jdf.queryExecution().toString()
    assert rows.first().text == "a < b"
