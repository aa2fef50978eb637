"""Text expressions: truncation notes, slugs, durations, JSON rescue."""

from __future__ import annotations

from pagewright.functions.core import Sql, keep, let, regex, transform, truncate
from pagewright.functions.entities import unescape_html  # noqa: F401  F14


def for_model(text: Sql, max_length: int | None = None) -> Sql:
    """text cut to what a model accepts, with a note; whole unless a length is given."""
    if max_length is None:
        return text
    return (f"if(length({text}) <= {max_length}, {text}, "
            f"concat({truncate(text, max_length - 100)}, '\\n\\n[Content truncated...]'))")


def for_export(text: Sql, max_length: int | None) -> Sql:
    """text cut for a report, with a note."""
    if not max_length:
        return text
    return (f"if(length({text}) > {max_length}, "
            f"concat({truncate(text, max_length)}, '\\n\\n*[Content truncated...]*'), {text})")


def short_summary(text: Sql, max_length: int = 500) -> Sql:
    """the start of the text, with dots when something was cut."""
    return f"if(length({text}) > {max_length}, concat({truncate(text, max_length)}, '...'), {text})"


def page_anchor(title: Sql, number: Sql) -> Sql:
    """``page-<number>-<slug>``, the slug cut to 30 characters."""
    dashed = f"regexp_replace(lower({title}), {regex(r'[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, '-')"
    slug = f"regexp_replace({dashed}, '^-+|-+$', '')"
    return let(slug, lambda s: (
        f"concat('page-', {number}, if({s} = '', '', concat('-', {truncate(s, 30)})))"))


def fixed_decimals(value: Sql, digits: int) -> Sql:
    """A non-negative double with `digits` decimals, rounded half to even on its exact value.

    Spark's own rounding starts from the shortest decimal text of a double, which turns
    numbers next to a tie into ties.  The fraction times 2^60 is exact as an integer.
    """
    one, scale = 1 << 60, 10 ** digits

    def rounded(x):
        fraction = f"cast(cast(({x} - floor({x})) * {float(one)!r}D as bigint) as decimal(38, 0))"
        return let(f"struct({fraction} * {scale} AS n, cast(floor({x}) as decimal(20, 0)) * {scale} AS whole)",
                   lambda p: let(f"struct({p}.whole + ({p}.n div {one}BD) AS low, {p}.n % {one}BD AS rest)", nearest))

    def nearest(p):
        up = f"{p}.rest > {one // 2}BD or ({p}.rest = {one // 2}BD and {p}.low % 2 = 1)"
        return f"cast({p}.low + if({up}, 1, 0) as bigint)"

    def written(n):
        return f"{n} div {scale}" + (f", '.', lpad({n} % {scale}, {digits}, '0')" if digits else "")

    return let(let(f"cast({value} as double)", rounded), lambda n: f"concat({written(n)})")


def duration_text(seconds: Sql) -> Sql:
    """whole seconds, whole minutes or hours with one decimal."""
    return f"""case
        when {seconds} < 60 then concat({fixed_decimals(seconds, 0)}, ' seconds')
        when {seconds} < 3600 then concat({fixed_decimals(f'({seconds} / 60D)', 0)}, ' minutes')
        else concat({fixed_decimals(f'({seconds} / 3600D)', 1)}, ' hours') end"""


def duration_text_1(seconds: Sql) -> Sql:
    """F8: seconds, minutes or hours, each with one decimal."""
    return f"""case
        when {seconds} < 60 then concat({fixed_decimals(seconds, 1)}, ' seconds')
        when {seconds} < 3600 then concat({fixed_decimals(f'({seconds} / 60D)', 1)}, ' minutes')
        else concat({fixed_decimals(f'({seconds} / 3600D)', 1)}, ' hours') end"""


def percent_text(part: Sql, whole: Sql) -> Sql:
    """``part / whole`` as a percentage with one decimal; the whole counts as 1 at least."""
    share = f"(cast({part} as double) / greatest({whole}, 1) * 100D)"
    return f"concat({fixed_decimals(share, 1)}, '%')"


def starts_object(text: Sql) -> Sql:
    """Is this JSON text an object?  Only for text that is known to be JSON."""
    opening = regex(r"^[ \t\n\r]*\{")
    return f"({text} rlike {opening})"


def whole_object(text: Sql) -> Sql:
    """The text when all of it is one JSON object, else NULL."""
    return f"if({starts_object(text)} and try_parse_json({text}) is not null, {text}, null)"


def json_object(text: Sql, fenced: bool = True) -> Sql:
    """the JSON object in a model's answer, as text, else NULL.

    Tries the whole text, then a fenced json block, then everything from the first to
    the last brace.  The first of them that is present decides.
    """
    fence, braces = regex(r"(?s)```json\s*(.*?)\s*```"), regex(r"(?s)\{.*\}")
    block = let(f"regexp_extract({text}, {fence}, 1)", whole_object)
    braced = let(f"regexp_extract({text}, {braces}, 0)", whole_object)
    fence_step = f"when {text} rlike {fence} then {block}" if fenced else ""
    return f"""case
        when try_parse_json({text}) is not null then if({starts_object(text)}, {text}, null)
        {fence_step}
        when {text} rlike {braces} then {braced} end"""


def join_values(values: Sql, separator: str = "; ") -> Sql:
    """a list as one cell."""
    return f"coalesce(array_join({values}, '{separator}'), '')"


def join_entries(entries: Sql, separator: str = "; ") -> Sql:
    """a map as one cell, ``key: value`` pairs."""
    pairs = transform(f"map_entries({entries})", lambda e: f"concat({e}.key, ': ', {e}.value)")
    return join_values(pairs, separator)
