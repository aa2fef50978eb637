"""URL filter: rules, and for other URLs a ratio of two character language models.

URLs that a rule accepts and URLs that a rule rejects train two smoothed Markov models of their
characters.  A character is predicted from the longest context, of up to two characters, that
was seen in training; each context's prediction is smoothed by that of the context without its
first character, with a weight that grows with the number of different characters seen after it.
A URL without a rule is allowed if the difference of its log-likelihoods, divided by its length,
reaches a threshold.  The threshold is the one with the best mean of both rates of right answers
on the fifth of the ruled URLs that the models don't see.

Everything is DataFrame expressions.  The alphabet is fixed, so counts and the table of log
ratios have `SYMBOLS`^3 entries at most, however many URLs there are.  URLs are neither grouped
nor shuffled; counts are combined before their shuffle.

A null URL and one without ``://`` have an empty host and path and follow no rule.  URLs without
characters have difference 0.  Without URLs of both kinds, models and threshold are those of no
evidence: difference and threshold 0, so all others are allowed.  Repeated rows are judged each;
other columns take no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&#:%"
#: The characters, one for all others and one before the start
SYMBOLS = len(ALPHABET) + 2
#: Part of the ruled URLs that set the threshold
FOLDS = 5
#: Differences are counted in steps of this width up to this size
STEP, SPAN = 0.01, 12

# Verdict, host and beginning of the path
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _folded(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def host_and_path(url: str = "url") -> tuple[str, str]:
    """SQL of the host (letters A to Z lower-cased) and of the path of a URL."""
    there = f"({url} IS NOT NULL AND locate('://', {url}) > 0)"
    rest = f"substring({url}, locate('://', {url}) + 3)"
    authority = f"regexp_extract({rest}, '^[^/?#]*', 0)"
    host = f"CASE WHEN {there} THEN {_folded(authority)} ELSE '' END"
    path = f"CASE WHEN {there} THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    return host, path


def matching_rule(rules=RULES) -> str:
    """SQL of the longest rule that fits host and path, with its verdict; null if none does."""
    cases = []
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = f"(host = '{host}' OR endswith(host, '.{host}')) AND startswith(path, '{path}')"
        cases.append(f"WHEN {fits} THEN named_struct('rule', '{host}{path}', 'verdict', '{verdict}')")
    return "CASE " + " ".join(cases) + " END"


def grams(url: str = "url") -> str:
    """SQL of a URL's characters with the two before each, as numbers below SYMBOLS^3."""
    others = "~"
    plain = f"regexp_replace({_folded(f'coalesce({url}, \"\")')}, '[^{ALPHABET.replace('-', '')}-]', '{others}')"
    codes = f"transform(filter(split({plain}, ''), c -> c <> ''), c -> instr('{ALPHABET}{others}', c))"
    wide = f"concat(array(0, 0), {codes})"
    return (f"transform(array(named_struct('p', {wide})), w -> if(size(w.p) = 2, CAST(array() AS array<int>), "
            f"transform(sequence(2, size(w.p) - 1), i -> (w.p[i - 2] * {SYMBOLS} + w.p[i - 1]) * {SYMBOLS} + w.p[i])))[0]")


def _smoothed(counts: DataFrame, kind: str) -> DataFrame:
    """Chance of every symbol after every two symbols, from counts by gram."""
    s = SYMBOLS
    dense = counts.sparkSession.range(s ** 3).join(counts.select(F.col("gram").alias("id"), F.col(kind).alias("n")), "id", "left").selectExpr(
        "id", f"id DIV {s} AS before", f"(id DIV {s}) % {s} AS last", f"id % {s} AS c", "coalesce(n, 0) AS n")
    two = dense.groupBy("last", "c").agg(F.sum("n").alias("n"))
    one = two.groupBy("c").agg(F.sum("n").alias("n"))

    def smooth(frame, by, lower):
        part = f"PARTITION BY {by}" if by else ""
        seen, kinds = f"(sum(n) OVER ({part}))", f"(sum(CAST(n > 0 AS int)) OVER ({part}))"
        return frame.withColumn("p", F.expr(f"CASE WHEN {seen} = 0 THEN {lower} ELSE (n + {kinds} * {lower}) / ({seen} + {kinds}) END"))

    one = smooth(one, "", f"(1 / {s}D)").select("c", F.col("p").alias("q"))
    two = smooth(two.join(one, "c"), "last", "q").select("last", "c", F.col("p").alias("q"))
    return smooth(dense.join(two, ["last", "c"]), "before", "q").select("id", F.col("p").alias(kind))


def log_ratios(ruled: DataFrame) -> DataFrame:
    """One row with the array of log ratios of all grams; `ruled` has verdict and grams."""
    counts = ruled.select("verdict", F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"))
    both = _smoothed(counts, "allow").join(_smoothed(counts, "block"), "id")
    return both.select("id", F.expr("ln(allow) - ln(block)").alias("w")).agg(
        F.expr("transform(array_sort(collect_list(struct(id, w))), x -> x.w)").alias("weights"))


def threshold_of(scored: DataFrame) -> DataFrame:
    """One row with the threshold; `scored` has verdict and difference of URLs kept from training."""
    steps = int(SPAN / STEP)
    bins = scored.selectExpr("verdict", f"CAST(greatest(-{steps}, least({steps}, floor(difference / {STEP}D))) AS int) AS bin").groupBy(
        "bin").agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"))
    # At most 2 * SPAN / STEP rows from here on.
    rates = bins.selectExpr(
        "bin", "sum(allow) OVER (ORDER BY bin DESC) AS kept", "sum(allow) OVER () AS allowed",
        "sum(block) OVER (ORDER BY bin) - block AS dropped", "sum(block) OVER () AS blocked")
    best = rates.selectExpr("bin", "kept / nullif(allowed, 0) + dropped / nullif(blocked, 0) AS good").where("good IS NOT NULL").orderBy(
        F.desc("good"), F.abs("bin"), "bin").limit(1)
    return best.agg(F.coalesce(F.max("bin") * F.lit(STEP), F.lit(0.0)).alias("threshold"))


def _constant(row: DataFrame, kind: str, names: list[str]) -> Column:
    """The only value of a one-row table as a session variable; array functions take no subqueries."""
    spark, name = row.sparkSession, f"value_{uuid.uuid4().hex}"
    names.append(name)
    row.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name} {kind}")
    spark.sql(f"SET VARIABLE {name} = (SELECT * FROM {name})")
    spark.catalog.dropTempView(name)
    return F.expr(name)


def fold(url: str = "url") -> str:
    """SQL of the part a URL belongs to; part 0 sets the threshold."""
    return f"CAST(conv(left(md5({url}), 8), 16, 10) AS long) % {FOLDS}"


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, difference (per character) and threshold of every page."""
    host, path = host_and_path()
    found = pages.select("page_id", "url").selectExpr("*", f"{host} AS host", f"{path} AS path").selectExpr("*", f"{matching_rule(rules)} AS found")
    urls = found.selectExpr("page_id", "url", "host", "path", "found.rule AS rule", "found.verdict AS verdict")
    # URLs decide their fold, so copies of one never lie on both sides.
    ruled = urls.where("rule IS NOT NULL").selectExpr("verdict", f"{grams()} AS grams", f"{fold()} AS fold")
    names: list[str] = []
    weights = _constant(log_ratios(ruled.where("fold > 0")), "array<double>", names)

    def difference(frame: DataFrame) -> DataFrame:
        total = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.element_at(weights, g + 1))
        return frame.withColumn("difference", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0))

    threshold = _constant(threshold_of(difference(ruled.where("fold = 0"))), "double", names)
    judged = difference(urls.withColumn("grams", F.expr(grams()))).withColumn("threshold", threshold)
    result = judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("difference") >= F.col("threshold"), "allow").otherwise("block")).alias("verdict"),
        "difference", "threshold")
    # The values are part of the plan by now.
    for name in names:
        pages.sparkSession.sql(f"DROP TEMPORARY VARIABLE {name}")
    return result
