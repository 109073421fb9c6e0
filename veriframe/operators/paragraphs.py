"""Paragraphs of printed documents from the lines on their pages.

What a line is (a printed number, the end of a sentence, a heading) is found by built-in functions.
Where paragraphs begin depends on the numbers printed before, through a whole document, so each
document is one pass over its sorted lines; it reads places and flags and not their texts. A
partition's documents follow one another, so none costs a call of its own.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from itertools import groupby
from math import nan

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A pitch over this multiple of the usual one parts paragraphs; a first line that stands
# in by so many points begins one; so many numbers in a row let numbering begin above 1.
GAP_RATIO, INDENT, RUN = 1.35, 12.0, 3
# A printed paragraph number, the end of a sentence, the longest heading.
MARKER, TERMINAL, LONGEST = r"(?U)^\s*(\d{1,3})[.)]\s", r"(?U)[.!?:;\"'”’)\]]\s*$", 120

# Fixed value: rows sent back at once, at least; a document is never parted.
_ROWS = 10_000


def marker(text: Column) -> Column:
    """The number printed at the head of a line, or null."""
    return F.regexp_extract(text, MARKER, 1).try_cast("int")


def heading(text: Column) -> Column:
    """A short line all of whose letters are capitals."""
    return text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]") & (F.length(text) < LONGEST)


def paragraphs(lines: DataFrame, furniture: DataFrame | None = None) -> DataFrame:
    """(doc, page, no, para_no, label, part): the paragraph of each line, its printed number if it has
    one that runs on, and the part of it (from 1; a paragraph has a part on each of its pages).

    lines: doc, page, no (in the order of reading), x0, y0, text; furniture: doc, page, no of what is
    printed on every page, left out. A null text is an empty line. A line begins a paragraph after
    more space than usual (the lower quartile of a page's pitches), or higher up (a new column), with
    the next printed number or an indent after a finished sentence, and between heading and text.
    The first paragraph of a page goes on with the last one unless that ended.
    """
    if furniture is not None:
        lines = lines.join(furniture.select("doc", "page", "no"), ["doc", "page", "no"], "left_anti")
    text = F.coalesce("text", F.lit(""))
    seen = lines.select("doc", "page", "no", "x0", "y0", F.coalesce(marker(text), F.lit(-1)).alias("marker"), text.rlike(TERMINAL).alias("ends"), heading(text).alias("heading"), F.length(text).alias("length"))
    kind = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = f"doc {kind['doc']}, page {kind['page']}, no {kind['no']}, para_no long, label int, part int"
    return seen.repartition("doc").sortWithinPartitions("doc", "page", "no").mapInArrow(_each_document, schema)


def joined(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc, para_no, label, page, last_page, n_lines, text): one row a paragraph, lines by line breaks."""
    rows = placed.join(lines.select("doc", "page", "no", F.coalesce("text", F.lit("")).alias("text")), ["doc", "page", "no"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "no", "text"))), lambda r: r.text)  # the lines of one paragraph
    return rows.groupBy("doc", "para_no").agg(F.max("label").alias("label"), F.min("page").alias("page"), F.max("page").alias("last_page"), F.count("*").alias("n_lines"), F.array_join(texts, "\n").alias("text"))


def _first_number(markers: list[int]) -> int | None:
    """The number that numbering begins with where that is not 1: the first that others run on from."""
    if 1 in markers:
        return None
    for i, n in enumerate(markers):
        run = 1
        for later in markers[i + 1 :]:
            run += later == n + run
        if run >= RUN:
            return n
    return None


_Line = namedtuple("_Line", "doc page no x0 y0 marker ends heading length")
_OUT = ["doc", "page", "no", "para_no", "label", "part"]


def _each_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a partition with their paragraphs, one document after the other."""
    kinds: list = []

    def lines() -> Iterator[_Line]:
        for batch in batches:
            kinds[:] = kinds or [batch.schema.field(i).type for i in range(3)]
            yield from map(_Line._make, zip(*[c.to_pylist() for c in batch.columns]))

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*kinds, pa.int64(), pa.int32(), pa.int32()])], _OUT)

    out: list = []
    for _, doc in groupby(lines(), key=lambda x: x.doc):
        out += _numbered([x if x.x0 is not None and x.y0 is not None else x._replace(x0=nan if x.x0 is None else x.x0, y0=nan if x.y0 is None else x.y0) for x in doc])
        if len(out) >= _ROWS:
            yield packed(out)
            out = []
    if out:
        yield packed(out)


def _numbered(lines: list[_Line]) -> list[tuple]:
    """The lines of one document, in order, with their paragraphs."""
    first = _first_number([x.marker for x in lines if x.marker >= 0])
    last = first - 1 if first is not None else 0  # the last number that ran on
    para, label, part, out = 0, None, 0, []
    before: list = []  # the lines of the last part
    for _, held_by_page in groupby(lines, key=lambda x: x.page):
        page = list(held_by_page)
        pitches = sorted(b.y0 - a.y0 for a, b in zip(page, page[1:]) if b.y0 > a.y0)
        usual = pitches[len(pitches) // 4] if pitches else 0.0
        held: list = []
        for line in page:
            next_number = line.marker == last + 1
            if not held or _begins(held, line, usual, next_number):
                goes_on = not held and before and not before[-1].ends and not _is_heading(before) and not line.heading and not next_number
                if goes_on:
                    part += 1
                else:
                    para, part, label = para + 1, 1, line.marker if next_number else None
                if next_number:
                    last = line.marker
                held = []
            held.append(line)
            before = held
            out.append((line.doc, line.page, line.no, para, label, part))
    return out


def _begins(held: list, line, usual: float, next_number: bool) -> bool:
    pitch, prev = line.y0 - held[-1].y0, held[-1]
    if pitch > GAP_RATIO * usual or pitch < 0:
        return True
    indented = len(held) >= 2 and line.x0 >= held[1].x0 + INDENT
    return prev.ends and (next_number or indented) or prev.heading != line.heading


def _is_heading(lines: list) -> bool:
    return all(x.heading for x in lines) and sum(x.length for x in lines) + len(lines) - 1 < LONGEST
