"""html entities decoded by expressions, without Python over the data.

The table of names is that of the standard library, as a map literal in two steps (first letter,
then name), so a look-up reads a few dozen entries.  A reference begins at each ``&``, so a text
is split there and every piece decides for itself what it begins with.
"""

from __future__ import annotations

from functools import cache
from html.entities import html5
from itertools import groupby

from pagewright.functions.core import Sql, let, quote, regex, transform

_AMPERSAND = "&"
#: Longest name that is looked at, in characters
_LONGEST = 32


@cache
def _names() -> Sql:
    """map<first letter, map<name, characters>>; names keep the semicolon that most need."""
    letters = []
    for letter, names in groupby(sorted(html5), key=lambda n: n[0]):
        entries = ", ".join(f"{quote(n)}, {_literal(html5[n])}" for n in names)
        letters.append(f"{quote(letter)}, map({entries})")
    return f"map({', '.join(letters)})"


def _literal(text: str) -> Sql:
    return "'" + "".join(f"\\U{ord(c):08x}" for c in text) + "'"


@cache
def _bare_names() -> str:
    """A pattern for the names that need no semicolon, longest first."""
    return "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


@cache
def _odd_numbers() -> Sql:
    """map<number, characters> of the numbers that don't stand for their own code point.

    Numbers of control characters are read as the western code page of 256 characters; zero is unknown.
    """
    odd = {0: "\N{REPLACEMENT CHARACTER}", 13: "\r"}
    for n in range(0x80, 0xA0):
        odd[n] = bytes([n]).decode("cp1252", "ignore") or chr(n)
    return "map(" + ", ".join(f"{n}L, {_literal(c)}" for n, c in odd.items()) + ")"


def character(code: Sql) -> Sql:
    """The character of a code point."""
    return f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')"


def _number(digits: Sql, base: int) -> Sql:
    """The character that a number stands for."""
    # More digits than the largest code point has need no exact value.
    significant = f"regexp_replace({digits}, '^0+(?=.)', '')"
    value = let(significant, lambda d: f"if(length({d}) > 8, 4294967295L, cast(conv({d}, {base}, 10) as long))")
    unknown = quote("\N{REPLACEMENT CHARACTER}")
    nothing = ("({0} between 1 and 8 or {0} = 11 or {0} between 14 and 31 or {0} = 127 or {0} between 64976 and 65007 "
               "or ({0} & 65534) = 65534)").format
    return let(value, lambda n: (
        f"case when {_odd_numbers()}[{n}] is not null then {_odd_numbers()}[{n}] "
        f"when {n} between 55296 and 57343 or {n} > 1114111 then {unknown} when {nothing(n)} then '' else {character(n)} end"))


def _after(piece: Sql) -> Sql:
    """What ``&`` and a piece of text without ``&`` decode to."""
    decimal, hexadecimal = regex("^#([0-9]+)"), regex("^#[xX]([0-9a-fA-F]+)")
    rest = f"substr({piece}, {{0}} + 1)".format

    def numeric(pattern, base, before):
        return let(f"regexp_extract({piece}, {pattern}, 1)", lambda d: (
            f"concat({_number(d, base)}, substr({piece}, {before} + length({d}) + "
            f"if(substr({piece}, {before} + length({d}), 1) = ';', 1, 0)))"))

    candidate = regex(rf"^([^\t\n\f <&#;]{{1,{_LONGEST}}};?)")
    bare = regex(f"^({_bare_names()})")

    def named(s):
        whole = f"{_names()}[left({s}, 1)][{s}]"
        short = let(f"regexp_extract({s}, {bare}, 1)", lambda b: (
            f"if({b} = '', concat('{_AMPERSAND}', {piece}), concat({_names()}[left({b}, 1)][{b}], {rest(f'length({b})')}))"))
        return let(whole, lambda w: f"if({w} is null, {short}, concat({w}, {rest(f'length({s})')}))")

    return (f"case when {piece} rlike {decimal} then {numeric(decimal, 10, 2)} "
            f"when {piece} rlike {hexadecimal} then {numeric(hexadecimal, 16, 3)} "
            f"else {let(f'regexp_extract({piece}, {candidate}, 1)', named)} end")


def unescape_html(text: Sql) -> Sql:
    """named and numeric references become characters; what is none stays as it is."""
    pieces = transform(f"split({text}, '{_AMPERSAND}')", lambda p, i: f"if({i} = 0, {p}, {_after(p)})", 2)
    return f"if(contains({text}, '{_AMPERSAND}'), array_join({pieces}, ''), {text})"
