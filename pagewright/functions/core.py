"""Building blocks for the expressions of this package.

Functions here and in the sibling modules take and return Spark SQL text, and the
operators hand the finished text to `F.expr`.  Deeply nested array expressions built
from `Column` objects cost thousands of driver round trips; SQL text costs one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable

# The characters that count as whitespace.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java regex class.
SPACE_CLASS = r"[\s\x1c-\x1f]"

_names = itertools.count()

Sql = str
Body = Callable[[Sql], Sql]


def quote(text: str) -> Sql:
    """A SQL string literal."""
    return "'" + "".join(
        c if c.isalnum() or c in " .,:;/-_#*[]()&=|<>{}!?%+@^" else f"\\u{ord(c):04x}" for c in text) + "'"


def regex(pattern: str) -> Sql:
    """A SQL literal for a regular expression."""
    return f"r'{pattern}'"


def words(values: Iterable[str]) -> Sql:
    return ", ".join(quote(v) for v in values)


def _lambda(body: Callable, arity: int) -> Sql:
    names = [f"v{next(_names)}" for _ in range(arity)]
    head = names[0] if arity == 1 else f"({', '.join(names)})"
    return f"{head} -> {body(*names)}"


def transform(array: Sql, body: Callable, arity: int = 1) -> Sql:
    return f"transform({array}, {_lambda(body, arity)})"


def keep(array: Sql, body: Callable, arity: int = 1) -> Sql:
    return f"filter({array}, {_lambda(body, arity)})"


def exists(array: Sql, body: Body) -> Sql:
    return f"exists({array}, {_lambda(body, 1)})"


def every(array: Sql, body: Body) -> Sql:
    return f"forall({array}, {_lambda(body, 1)})"


def fold(array: Sql, start: Sql, body: Callable, finish: Body | None = None) -> Sql:
    tail = "" if finish is None else f", {_lambda(finish, 1)}"
    return f"aggregate({array}, {start}, {_lambda(body, 2)}{tail})"


def let(value: Sql, body: Body) -> Sql:
    """Evaluate `value` once and use it several times.

    Also for a column that a lambda reads: of a column that is named once Spark puts the expression in place of
    the name, and inside a lambda that would run over the whole page for every item.
    """
    return f"transform(array({value}), {_lambda(body, 1)})[0]"


def struct(**fields: Sql) -> Sql:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def either(*choices: Sql) -> Sql:
    return f"coalesce({', '.join(choices)})"


def strip(text: Sql) -> Sql:
    return f"btrim({text}, {quote(SPACES)})"


def collapse_spaces(text: Sql) -> Sql:
    """every run of whitespace becomes one blank."""
    return f"regexp_replace({text}, {regex(f'(?U){SPACE_CLASS}+')}, ' ')"


def non_empty(text: Sql) -> Sql:
    """NULL when the text is empty, so that `either` can pick the next choice."""
    return f"nullif({text}, '')"


def contains_any(text: Sql, parts: Iterable[str]) -> Sql:
    """does the text contain at least one of the parts?"""
    return f"({text} rlike {regex('|'.join(re.escape(p) for p in parts))})"


def count_contained(text: Sql, parts: Iterable[str]) -> Sql:
    """How many of the parts does the text contain?"""
    return f"size(filter(array({words(parts)}), w -> contains({text}, w)))"


def truncate(text: Sql, length: int | None) -> Sql:
    """the first `length` code points; None keeps the whole text."""
    return text if length is None else f"left({text}, {int(length)})"
