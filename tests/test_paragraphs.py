"""Paragraphs of planted pages."""

from pyspark.sql import functions as F

from veriframe.operators import paragraphs as P

SCHEMA = "doc string, page long, no long, x0 double, y0 double, text string"


def found(spark, *pages, doc="d", furniture=None):
    """The texts of the paragraphs; a line is a text, (text, extra space before) or (text, space, indent)."""
    rows = []
    for p, page in enumerate(pages):
        y = 0.0
        for k, line in enumerate(page):
            text, space, indent = (*line, 0, 0)[:3] if isinstance(line, tuple) else (line, 0, 0)
            y += 12 + space
            rows.append((doc, p, k, 72.0 + indent, y, text))
    lines = spark.createDataFrame(rows, SCHEMA)
    left = None if furniture is None else spark.createDataFrame(furniture, "doc string, page long, no long")
    got = P.joined(lines, P.paragraphs(lines, left)).orderBy("para_no").collect()
    return [(r.label, r.text.replace("\n", " ")) for r in got], got


def test_space_headings_and_indents(spark):
    got, _ = found(spark, ["THE TITLE", "OF THE REPORT", "A first line", "and its end.", ("Spaced off", 10), "goes on", ("Indented here. ", 0, 20), "and on.", ("Now it begins", 0, 20), "plain"])
    # an indent counts against the second line of its paragraph, and only after a finished sentence
    assert [t for _, t in got] == ["THE TITLE OF THE REPORT", "A first line and its end.", "Spaced off goes on Indented here.  and on.", "Now it begins plain"]


def test_numbers_run_on(spark):
    got, _ = found(spark, ["1. The first ends.", "2. The second, see", "4. of the list.", "3. The third."], ["4. The fourth goes", "over the page and"], ["on to its end.", "5. The fifth."])
    assert got == [(1, "1. The first ends."), (2, "2. The second, see 4. of the list."), (3, "3. The third."), (4, "4. The fourth goes over the page and on to its end."), (5, "5. The fifth.")]


def test_a_paragraph_over_a_page_is_one(spark):
    got, rows = found(spark, ["It goes on", "without an end"], ["over here", "and here.", ("Then another.", 20)], ["New one, as that ended."])
    assert [(r.page, r.last_page, r.n_lines) for r in rows] == [(0, 1, 4), (1, 1, 1), (2, 2, 1)]


def test_an_excerpt_begins_with_its_own_number(spark):
    assert [n for n, _ in found(spark, ["21. One.", "22. Two.", "23. Three."])[0]] == [21, 22, 23]
    assert [n for n, _ in found(spark, ["Some words.", "7. Alone.", "Other words."])[0]] == [None]


def test_a_new_column_and_furniture(spark):
    lines = spark.createDataFrame([("d", 0, k, 72.0, y, t) for k, (y, t) in enumerate([(1.0, "CASE 12"), (12.0, "left one"), (24.0, "left two"), (12.0, "right one"), (24.0, None)])], SCHEMA)
    placed = P.paragraphs(lines, spark.createDataFrame([("d", 0, 0), ("e", 0, 1)], "doc string, page long, no long"))
    assert [(r.no, r.para_no, r.part) for r in placed.orderBy("no").collect()] == [(1, 1, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_documents_are_apart_and_empty_ones_are_none(spark):
    rows = [(d, 0, k, 72.0, 12.0 * k, f"{k + 1}. Line.") for d in "ab" for k in range(3)]
    lines = spark.createDataFrame(rows, SCHEMA)
    got = P.paragraphs(lines.withColumn("text_", F.lit("clash")))
    assert sorted((r.doc, r.para_no, r.label) for r in got.collect()) == [(d, k, k) for d in "ab" for k in (1, 2, 3)]
    assert P.paragraphs(lines.limit(0)).count() == 0
