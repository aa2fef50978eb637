"""Expressions over the arrays of a parsed page.

An element is a contiguous range of ``elements`` and of ``texts``, so "inside X"
is a `slice` and costs the size of X.  Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable

from pagewright.functions.core import (
    SPACE_CLASS, Body, Sql, contains_any, every, fold, keep, let, non_empty, regex, strip, struct,
    transform, words,
)
from pagewright.sources.parse import BOX_TAGS, ELEMENT, TEXT

# Elements that never hold content.
NOISE_TAGS = [
    "script", "style", "noscript", "iframe", "svg",
    "nav", "footer", "header", "aside", "form",
    "button", "input", "select", "textarea",
]
# Substrings of class or id that mark noise ("ad" also hits "header").
NOISE_INDICATORS = [
    "sidebar", "widget", "nav", "menu", "footer",
    "header", "comment", "ad", "advertisement",
    "social", "share", "related", "popular",
]


NO_STRINGS = "cast(array() as array<string>)"


def attr(element: Sql, name: str) -> Sql:
    """Attribute value, NULL when the element or the attribute is missing."""
    return f"{element}.attrs['{name}']"


def filled_attr(element: Sql, name: str) -> Sql:
    """Attribute value, NULL also when it is empty."""
    return non_empty(attr(element, name))


def with_tag(elements: Sql, *tags: str) -> Sql:
    return keep(elements, lambda e: f"{e}.tag in ({words(tags)})")


def first_where(elements: Sql, condition: Body) -> Sql:
    """First element that meets the condition, else NULL."""
    return f"get({keep(elements, condition)}, 0)"


def first_tag(elements: Sql, tag: str) -> Sql:
    return first_where(elements, lambda e: f"{e}.tag = '{tag}'")


def tokens(value: Sql) -> Sql:
    """A token-list attribute (class, rel) with single blanks between tokens."""
    spaces = regex(f"(?U){SPACE_CLASS}+")
    return strip(f"regexp_replace({value}, {spaces}, ' ')")


def class_and_id(element: Sql) -> Sql:
    """Lower-case "class id" text that the indicator lists are matched against."""
    return (f"lower(concat(coalesce({tokens(attr(element, 'class'))}, ''), ' ', "
            f"coalesce({attr(element, 'id')}, '')))")


def marked_with(element: Sql, indicators: Iterable[str]) -> Sql:
    """Does "class id" contain one of the indicators?  Most elements have neither."""
    return (f"(({attr(element, 'class')} is not null or {attr(element, 'id')} is not null) and "
            f"{contains_any(class_and_id(element), indicators)})")


def inner(array: Sql, element: Sql) -> Sql:
    """The part of a text-aligned array that lies inside the element."""
    return f"slice({array}, {element}.text_from, {element}.text_to - {element}.text_from)"


def descendants(elements: Sql, element: Sql) -> Sql:
    return f"slice({elements}, {element}.pos + 1, {element}.last - {element}.pos)"


def page_strings(texts: Sql) -> Sql:
    """Stripped strings, '' for scripts, styles, comments and the like."""
    return transform(texts, lambda t: f"if({t}.box = '', {strip(t + '.raw')}, '')")


def join_strings(strings: Sql, separator: str = "") -> Sql:
    return f"array_join({keep(strings, lambda s: s + ' <> ' + repr(''))}, '{separator}')"


def element_text(strings: Sql, element: Sql, separator: str = "") -> Sql:
    """Stripped text of an element; `strings` comes from `page_strings`."""
    return join_strings(inner(strings, element), separator)


def boxed_text(texts: Sql, strings: Sql, element: Sql) -> Sql:
    """Like `element_text`, but a script or template element sees its own strings."""
    own = transform(keep(inner(texts, element), lambda t: f"{t}.box = {element}.tag"),
                    lambda t: strip(t + ".raw"))
    return (f"case when {element}.tag in ({words(BOX_TAGS)}) then {join_strings(own)} "
            f"else {element_text(strings, element)} end")


def single_string(elements: Sql, texts: Sql, element: Sql) -> Sql:
    """The only string of an element, NULL unless every level has exactly one child."""
    chain = f"slice({elements}, {element}.pos, {element}.last - {element}.pos + 1)"
    return (f"case when {element}.text_to - {element}.text_from = 1 "
            f"and {every(chain, lambda e: e + '.kids = 1')} "
            f"then get({texts}, {element}.text_from - 1).raw end")


# Noisy elements that a fold collects before it starts a new array.
_RUN = 256
_RANGE = "struct<pos:int,last:int,text_from:int,text_to:int,paragraphs:int,chars:int>"
NO_RANGES = f"cast(array() as array<{_RANGE}>)"


def _paragraphs_of(element: Sql) -> Sql:
    """Paragraphs of an element, itself included."""
    return f"({element}.paragraphs + if({element}.tag = 'p', 1, 0))"


def noise_ranges(elements: Sql, tags: Iterable[str] = NOISE_TAGS,
                 indicators: Iterable[str] = NOISE_INDICATORS) -> Sql:
    """The outermost noisy elements, in order, without overlap.

    ``paragraphs`` and ``chars`` are running totals of what all ranges up to this one hold.
    Found ranges are kept in runs, so that adding one copies a run and not all of them.
    """
    noisy = keep(elements, lambda e: f"{e}.tag in ({words(tags)}) or {marked_with(e, indicators)}")
    empty = NO_RANGES
    no_runs = f"cast(array() as array<array<{_RANGE}>>)"

    def widen(done, e):
        found = struct(pos=f"{e}.pos", last=f"{e}.last", text_from=f"{e}.text_from", text_to=f"{e}.text_to",
                       paragraphs=f"{done}.paragraphs + {_paragraphs_of(e)}", chars=f"{done}.chars + {e}.chars")
        full = f"size({done}.run) >= {_RUN}"
        wider = struct(last=f"{e}.last", paragraphs=f"{done}.paragraphs + {_paragraphs_of(e)}", chars=f"{done}.chars + {e}.chars", runs=f"if({full}, concat({done}.runs, array({done}.run)), {done}.runs)",
                       run=f"if({full}, array({found}), concat({done}.run, array({found})))")
        return f"if({e}.pos > {done}.last, {wider}, {done})"

    return fold(noisy, struct(last="0", paragraphs="0", chars="0", runs=no_runs, run=empty), widen,
                lambda done: f"concat(flatten({done}.runs), {done}.run)")


def _blank_out(array: Sql, ranges: Sql, start: str, stop: str, filler: Sql) -> Sql:
    """Replace the ranges by the filler; positions stay as they are."""
    def piece(r, i):
        before = f"if({i} = 0, 1, {stop.format(f'get({ranges}, {i} - 1)')})"
        return (f"concat(slice({array}, {before}, {start.format(r)} - {before}), "
                f"array_repeat({filler}, {stop.format(r)} - {start.format(r)}))")

    last = stop.format(f"get({ranges}, size({ranges}) - 1)")
    rest = let(f"if(size({ranges}) = 0, 1, {last})",
               lambda n: f"slice({array}, {n}, greatest(size({array}) - {n} + 1, 0))")
    # Most pages have nothing to blank out.
    return f"if(size({ranges}) = 0, {array}, concat(flatten({transform(ranges, piece, 2)}), {rest}))"


def noise_totals(elements: Sql, ranges: Sql) -> Sql:
    """For every place, what the noise up to there (a range counts from its start) holds.

    The clean part of an element is then its own total less the difference of two places.
    """
    def total(r):
        return struct(paragraphs=f"{r}.paragraphs", chars=f"{r}.chars")

    none = struct(paragraphs="0", chars="0")

    def piece(r, i):
        before = f"if({i} = 0, 0, get({ranges}, {i} - 1).last)"
        earlier = f"if({i} = 0, {none}, {total(f'get({ranges}, {i} - 1)')})"
        return f"concat(array_repeat({earlier}, {r}.pos - 1 - {before}), array_repeat({total(r)}, {r}.last - {r}.pos + 1))"

    last = f"get({ranges}, size({ranges}) - 1)"
    rest = (f"if(size({ranges}) = 0, array_repeat({none}, size({elements})), "
            f"array_repeat({total(last)}, greatest(size({elements}) - {last}.last, 0)))")
    return f"concat(flatten({transform(ranges, piece, 2)}), {rest})"


def without_noise(elements: Sql, ranges: Sql) -> Sql:
    """Elements with noise replaced by NULL."""
    return _blank_out(elements, ranges, "{}.pos", "({}.last + 1)",
                      f"cast(null as {ELEMENT.simpleString()})")


def texts_without_noise(texts: Sql, ranges: Sql) -> Sql:
    """Texts with noise replaced by empty strings."""
    return _blank_out(texts, ranges, "{}.text_from", "{}.text_to",
                      f"cast({struct(box=repr(''), raw=repr(''))} as {TEXT.simpleString()})")


def parent_of(elements: Sql, element: Sql) -> Sql:
    """The parent element, NULL at the top."""
    return f"get({elements}, {element}.parent - 1)"


def near_ancestor(elements: Sql, element: Sql, levels: int, condition: Body) -> Sql:
    """Does one of the nearest `levels` ancestors meet the condition?"""
    def look(p):
        further = f" or {near_ancestor(elements, p, levels - 1, condition)}" if levels > 1 else ""
        return f"{p} is not null and (coalesce({condition(p)}, false){further})"

    return let(parent_of(elements, element), look)
