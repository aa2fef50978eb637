"""The parse job: html text -> element and text arrays, one row per page.

This is the only stage that runs Python over the data.  It is a map over Arrow
batches, needs no shuffle, and emits two flat arrays per page so that everything
after it is a Spark expression:

* ``elements`` in document order.  An element covers the elements
  ``pos .. last`` and the texts ``text_from .. text_to - 1`` (both 1-based), so
  "inside X" is a slice, never a search.  ``paragraphs`` and ``chars`` are totals of what is
  inside: elements named p, and characters of ordinary text.
* ``texts``: the strings between tags.  ``box`` names the kind of string
  ('' for ordinary text, else script/style/template/rt/rp/comment/cdata).
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Tasks carry this module with them, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ELEMENT = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("kids", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("text_from", T.IntegerType()),
    T.StructField("text_to", T.IntegerType()),
    T.StructField("paragraphs", T.IntegerType()),
    T.StructField("chars", T.IntegerType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])
TEXT = T.StructType([
    T.StructField("box", T.StringType()),
    T.StructField("raw", T.StringType()),
])
PARSED_FIELDS = [
    T.StructField("elements", T.ArrayType(ELEMENT)),
    T.StructField("texts", T.ArrayType(TEXT)),
    T.StructField("parse_error", T.StringType()),
]

# Elements that never have content.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input "
    "isindex keygen link menuitem meta nextid param source spacer track wbr".split()
)
# Elements whose strings are not part of a page's text.
BOX_TAGS = ("script", "style", "template", "rt", "rp")
# Elements that keep whitespace-only strings as they are.
KEEP_SPACE_TAGS = ("pre", "textarea")

_MARKED_TAGS = frozenset(BOX_TAGS + KEEP_SPACE_TAGS)
_ASCII_SPACES = " \n\t\f\r"
_PLAIN = re.compile(
    r'([^<&]+)'
    r'|<([a-zA-Z][a-zA-Z0-9]*)((?: +[a-zA-Z][a-zA-Z0-9:_-]*="[^"<>&]*")*)>'
    r'|</([a-zA-Z][a-zA-Z0-9]*)>'
    r'|&([a-zA-Z][-.a-zA-Z0-9]*);'
).match
_PLAIN_ATTRS = re.compile(r'([a-zA-Z][a-zA-Z0-9:_-]*)="([^"]*)"').findall
_RAW_END = {tag: re.compile(rf"</{tag}(>)?", re.I).search for tag in ("script", "style")}
#: Interpreters whose standard parser reads plain markup as the shortcut does (see the fuzz test)
CHECKED_VERSIONS = {(3, 13, 0)}
#: An output batch ends with the page that reaches one of these
_FLUSH_ELEMENTS = 16_000
_FLUSH_CHARS = 2 << 20


class _Columns:
    """Flat column buffers of one output batch; numbers are kept as numbers, not as objects."""

    def __init__(self):
        self.pos, self.last, self.parent, self.kids = (array("i") for _ in range(4))
        self.text_from, self.text_to, self.paragraphs, self.inside = (array("i") for _ in range(4))
        self.tag = []
        self.attr_from, self.attr_key, self.attr_value = array("i", [0]), [], []
        self.box, self.raw = [], []
        self.element_from, self.text_offsets, self.error = array("i", [0]), array("i", [0]), []
        self.chars = 0

    def close_page(self, error):
        self.element_from.append(len(self.pos))
        self.text_offsets.append(len(self.raw))
        self.error.append(error)

    def drop_open_page(self):
        e, t = self.element_from[-1], self.text_offsets[-1]
        for column in (self.pos, self.last, self.parent, self.kids, self.tag,
                       self.text_from, self.text_to, self.paragraphs, self.inside):
            del column[e:]
        del self.attr_from[e + 1:]
        del self.attr_key[self.attr_from[-1]:]
        del self.attr_value[self.attr_from[-1]:]
        del self.box[t:]
        del self.raw[t:]

    def arrays(self):
        def numbers(column):
            return pa.array(np.frombuffer(column, np.int32) if column else np.empty(0, np.int32))

        attrs = pa.MapArray.from_arrays(
            numbers(self.attr_from),
            pa.array(self.attr_key, pa.string()),
            pa.array(self.attr_value, pa.string()),
        )
        elements = pa.StructArray.from_arrays(
            [numbers(self.pos), numbers(self.last), numbers(self.parent),
             numbers(self.kids), pa.array(self.tag, pa.string()),
             numbers(self.text_from), numbers(self.text_to),
             numbers(self.paragraphs), numbers(self.inside), attrs],
            names=[f.name for f in ELEMENT.fields],
        )
        texts = pa.StructArray.from_arrays(
            [pa.array(self.box, pa.string()), pa.array(self.raw, pa.string())],
            names=[f.name for f in TEXT.fields],
        )
        return [
            pa.ListArray.from_arrays(numbers(self.element_from), elements),
            pa.ListArray.from_arrays(numbers(self.text_offsets), texts),
            pa.array(self.error, pa.string()),
        ]


class _PageReader(HTMLParser):
    """Feeds standard-library parse events into `_Columns`.

    No end tag is implied: an end tag closes back to the nearest open element of
    that name and is ignored when there is none.
    """

    def __init__(self, out: _Columns):
        super().__init__(convert_charrefs=False)
        self.out = out

    def read(self, html: str) -> None:
        self.reset()
        out = self.out
        self.first, self.first_text = len(out.pos), len(out.raw)
        self.open, self.open_names = [], {}
        self.boxes, self.keep_space = [], 0
        self.pending, self.ignored_ends = [], {}
        self.paragraphs = self.inside = 0  # so far, in the page
        self.rawdata = html
        self.goahead(False)
        if self.rawdata:
            self.close()
        self._flush()
        while self.open:
            self._pop()

    def _flush(self):
        pending = self.pending
        if pending:
            raw = pending[0] if len(pending) == 1 else "".join(pending)
            pending.clear()
            if raw[:1] in _ASCII_SPACES and not raw.strip(_ASCII_SPACES) and not self.keep_space:
                raw = "\n" if "\n" in raw else " "
            self._string(self.boxes[-1] if self.boxes else "", raw)

    def _string(self, box, raw):
        out = self.out
        if self.open:
            out.kids[self.open[-1][0]] += 1
        out.box.append(box)
        out.raw.append(raw)
        out.chars += len(raw)
        if not box:
            self.inside += len(raw)

    def _pop(self):
        out = self.out
        index, tag = self.open.pop()
        self.open_names[tag] -= 1
        if tag in _MARKED_TAGS:
            if tag in KEEP_SPACE_TAGS:
                self.keep_space -= 1
            else:
                self.boxes.pop()
        out.last[index] = len(out.pos) - self.first
        out.paragraphs[index] = self.paragraphs - out.paragraphs[index]
        out.inside[index] = self.inside - out.inside[index]
        out.text_to[index] = len(out.raw) - self.first_text + 1

    def _push(self, tag, attrs):
        self._flush()
        out, parent = self.out, 0
        index = len(out.pos)
        if self.open:
            top = self.open[-1][0]
            out.kids[top] += 1
            parent = top - self.first + 1
        pos = index - self.first + 1
        start = len(out.raw) - self.first_text + 1
        out.pos.append(pos)
        out.last.append(pos)
        out.parent.append(parent)
        out.kids.append(0)
        out.tag.append(tag)
        out.text_from.append(start)
        out.text_to.append(start)
        if attrs:
            # the last of repeated attributes wins
            named = {k: "" if v is None else v for k, v in attrs}
            out.attr_key.extend(named)
            out.attr_value.extend(named.values())
        out.attr_from.append(len(out.attr_key))
        if tag in VOID_TAGS:
            out.paragraphs.append(0)
            out.inside.append(0)
            return False
        if tag == "p":
            self.paragraphs += 1
        # Totals at the start; the end takes the difference.
        out.paragraphs.append(self.paragraphs)
        out.inside.append(self.inside)
        self.open.append((index, tag))
        self.open_names[tag] = self.open_names.get(tag, 0) + 1
        if tag in _MARKED_TAGS:
            if tag in KEEP_SPACE_TAGS:
                self.keep_space += 1
            else:
                self.boxes.append(tag)
        return True

    def _end(self, tag):
        self._flush()
        if self.open_names.get(tag):
            while self.open[-1][1] != tag:
                self._pop()
            self._pop()

    def goahead(self, end):
        """Read plain markup with one pattern; hand the rest to the base class.

        Plain are texts, tags with double-quoted attributes, named entities, comments and
        finished scripts and styles.  At the first token of another kind the tolerant
        base class takes over for the remainder of the page, so results are the same.
        """
        if sys.version_info[:3] not in CHECKED_VERSIONS:
            super().goahead(end)
            return
        data, i = self.rawdata, 0
        while not self.cdata_elem:
            token = _PLAIN(data, i)
            if token is None:
                if not data.startswith("<!", i):
                    break
                after = self.parse_comment(i) if data.startswith("<!--", i) else self.parse_html_declaration(i)
                if after < 0:
                    break
                i = after
                continue
            i, kind = token.end(), token.lastindex
            if kind == 1:
                self.pending.append(token[1])
            elif kind == 3:
                tag, attrs = token[2].lower(), token[3]
                self.handle_starttag(tag, [(k.lower(), v) for k, v in _PLAIN_ATTRS(attrs)] if attrs else None)
                if tag in self.CDATA_CONTENT_ELEMENTS:
                    closed = _RAW_END[tag](data, i)
                    if closed is None or not closed.group(1):
                        self.set_cdata_mode(tag)
                        break
                    if closed.start() > i:
                        self.pending.append(data[i:closed.start()])
                    self.handle_endtag(tag)
                    i = closed.end()
            elif kind == 4:
                self.handle_endtag(token[4].lower())
            else:
                self.handle_entityref(token[5])
        self.rawdata = data[i:]
        if self.rawdata:
            super().goahead(end)

    # parser events
    def handle_starttag(self, tag, attrs):
        if not self._push(tag, attrs):
            self.ignored_ends[tag] = self.ignored_ends.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        if self._push(tag, attrs):
            self._end(tag)

    def handle_endtag(self, tag):
        if self.ignored_ends.get(tag):
            self.ignored_ends[tag] -= 1
        else:
            self._end(tag)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_entityref(self, name):
        self.pending.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        digits = name[1:] if name[:1] in "xX" else name
        try:
            code = int(digits, 16 if digits != name else 10)
            char = bytes([code]).decode("windows-1252", "ignore") if code < 256 else ""
            self.pending.append(char or chr(code))
        except (ValueError, OverflowError):
            self.pending.append("\N{REPLACEMENT CHARACTER}")

    def _aside(self, box, raw):
        self._flush()
        self._string(box, raw)

    def handle_comment(self, data):
        self._aside("comment", data)

    def handle_decl(self, decl):
        self._aside("comment", decl)

    def handle_pi(self, data):
        self._aside("comment", data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._aside("", data[len("CDATA["):])
        else:
            self._aside("comment", data)


def _parse_batches(html_col: str, kept: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from parse(batch)
            del batch  # before the next one is read

    def parse(batch):
        html = batch.column(html_col)
        rest = batch.select(kept)
        start, out = 0, _Columns()
        reader = _PageReader(out)
        for row in range(batch.num_rows):
            text = html[row].as_py()
            error = None
            try:
                if text is None:
                    error = "page has no html"
                else:
                    reader.read(text)
            except Exception as exc:  # whatever it is, it is this page's failure
                error = str(exc) or type(exc).__name__
                out.drop_open_page()
            out.close_page(error)
            if len(out.pos) >= _FLUSH_ELEMENTS or out.chars >= _FLUSH_CHARS or row + 1 == batch.num_rows:
                ready = _emit(rest, start, row + 1, out, names)
                start, out = row + 1, _Columns()
                reader = _PageReader(out)
                yield ready

    return run


def _emit(rest, start, stop, out, names):
    part = rest.slice(start, stop - start)
    return pa.RecordBatch.from_arrays(part.columns + out.arrays(), names=names)


def parse_pages(pages: DataFrame, html_col: str = "html", keep_html: bool = False) -> DataFrame:
    """Parse each page once.  All other columns pass through untouched.

    A page that cannot be parsed keeps its row, with ``parse_error`` set and empty
    arrays.  Persist or write the result when several operators read it.
    """
    kept = [c for c in pages.columns if keep_html or c != html_col]
    schema = T.StructType([pages.schema[c] for c in kept] + PARSED_FIELDS)
    return pages.mapInArrow(_parse_batches(html_col, kept, schema.names), schema)
