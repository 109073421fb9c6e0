"""Reading reports: time cells, day and month order, page furniture, thread keys, stated times.

Cells that cannot be read with certainty become a problem with its reason, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CELL = r"^\s*(\d{1,4})[/.\-](\d{1,2})[/.\-](\d{1,4})(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?)?\s*(?:\(?UTC\s*([+-]\d{1,2})(?::?(\d{2}))?\)?)?\s*$"


#: Name of the column that holds a cell's parts while it is read.
_PARTS = "__parts"


def _with_parts(cells: DataFrame, cell: str) -> DataFrame:
    """``cells`` with the parts of the cell, found once: nine texts ('' where it has none); null if it
    is no time."""
    c = F.col(cell)
    parts = F.split(F.regexp_replace(c, _CELL, "".join(f"${k}|" for k in range(1, 10))), r"\|")
    return cells.withColumn(_PARTS, F.when(c.rlike(_CELL), parts))


def _part(k: int) -> Column:
    return F.coalesce(F.col(_PARTS)[k - 1], F.lit(""))


def _int(c: Column) -> Column:
    """A part's number; null if it is empty (a cast that fails costs an exception of its own)."""
    return F.when(c != "", c).try_cast("int")


def date_order(cells: DataFrame, by: str, cell: str) -> DataFrame:
    """(by, n_dmy, n_mdy, date_order): a first number over 12 votes day first, a second over 12 month
    first; both is a conflict, neither undecided."""
    a, b = _int(_part(1)), _int(_part(2))
    year_first = F.length(_part(1)) == 4
    t = _with_parts(cells, cell).groupBy(by).agg(F.count_if(~year_first & (a > 12)).alias("n_dmy"), F.count_if(~year_first & (b > 12)).alias("n_mdy"))
    d, m = F.col("n_dmy") > 0, F.col("n_mdy") > 0
    return t.withColumn("date_order", F.when(d & m, "conflict").when(d, "dmy").when(m, "mdy").otherwise("undecided"))


def parse_times(cells: DataFrame, cell: str, order: str, offset_min: str) -> DataFrame:
    """``cells`` with ``us`` (or null) and ``problem``: unreadable, two_digit_year, date_only,
    undecided_order, bad_date, no_offset. An offset in the cell wins over the column's."""
    p = [None, *(_part(k) for k in range(1, 10))]
    year_first = F.length(p[1]) == 4
    y = _int(F.when(year_first, p[1]).otherwise(p[3]))
    first, other = _int(F.when(year_first, p[2]).otherwise(p[1])), _int(F.when(year_first, p[3]).otherwise(p[2]))
    dmy = ~year_first & (F.col(order) == "dmy")
    month, day = F.when(dmy, other).otherwise(first), F.when(dmy, first).otherwise(other)
    half = F.lower(p[7])
    hour = _int(p[4])
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    minute, second = _int(p[5]), F.coalesce(_int(p[6]), F.lit(0))
    # what cannot be is told by its numbers: a parser fails by an exception
    can_be = (y >= 1) & month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 59)
    local = F.when(can_be, F.try_make_timestamp(y, month, day, hour, minute, second))
    stated = F.when(p[8] != "", _int(p[8]) * 60 + F.signum(_int(p[8])).cast("int") * F.coalesce(_int(p[9]), F.lit(0)))
    offset = F.coalesce(stated, F.col(offset_min))
    known_order = year_first | F.col(order).isin("dmy", "mdy")
    problem = (
        F.when(F.col(_PARTS).isNull(), "unreadable").when(F.length(F.when(year_first, p[1]).otherwise(p[3])) != 4, "two_digit_year").when(p[4] == "", "date_only")
        .when(~known_order, "undecided_order").when(F.col("__local").isNull(), "bad_date").when(offset.isNull(), "no_offset")
    )
    us = F.unix_micros("__local") - offset.cast("long") * 60_000_000
    read = _with_parts(cells, cell).withColumn("__local", local).withColumn("problem", problem)
    return read.withColumn("us", F.when(F.col("problem").isNull(), us)).drop(_PARTS, "__local")


def duration_seconds(cell: Column) -> Column:
    """HH:MM:SS or MM:SS as seconds, null if it is neither."""
    h, m, s = [F.regexp_extract(cell, r"^(?:(\d+):)?(\d{1,2}):(\d{2})$", k) for k in (1, 2, 3)]
    return F.when(cell.rlike(r"^(?:\d+:)?\d{1,2}:\d{2}$"), F.coalesce(_int(h), F.lit(0)) * 3600 + _int(m) * 60 + _int(s))


def furniture(lines: DataFrame, share: float = 0.6, least: int = 2) -> DataFrame:
    """Shapes (digits ignored) of margin lines that stand on at least ``share`` of a document's
    pages. lines: doc, page, text."""
    shape = F.trim(F.regexp_replace("text", r"\d+", "#"))
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    t = lines.withColumn("shape", shape).groupBy("doc", "shape").agg(F.count_distinct("page").alias("n")).join(pages, "doc")
    return t.filter((F.col("n") >= least) & (F.col("n") >= share * F.col("pages")) & (F.col("shape") != "")).select("doc", "shape", "n")


def thread_key(chat: Column, parties: Column) -> Column:
    """The chat's own id, else its sorted parties."""
    return F.coalesce(F.when(F.trim(chat) != "", F.trim(chat)), F.array_join(F.array_sort(F.array_distinct(F.array_compact(parties))), "|"))


def formula_guard(c: Column) -> Column:
    """Cells a spreadsheet would run get a leading quote."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


_MONTHS = "january february march april may june july august september october november december".split()
_STATED = r"(?i)\b(" + "|".join(_MONTHS) + r")\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?(?:,?\s+(?:at\s+)?(?:about\s+)?(\d{1,2}):(\d{2})\s*([ap])\.?m\.?)?"


def stated_times(paragraphs: DataFrame, text: str, zone: str) -> DataFrame:
    """Dates and times a paragraph states: (doc, para, kind, lo_us, hi_us), half-open.

    A missing year is taken from the document only if it states one year alone; a bare date is
    its whole day in the zone, "about" widens a moment by 8 minutes each way.
    """
    hits = paragraphs.select("doc", "para", F.explode(F.regexp_extract_all(text, F.lit(_STATED), F.lit(0))).alias("said"))
    g = [F.regexp_extract("said", _STATED, k) for k in range(7)]
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(g[1]))
    years = hits.select("doc", _int(g[3]).alias("y")).filter("y IS NOT NULL").groupBy("doc").agg(F.min("y").alias("lo_y"), F.max("y").alias("hi_y"))
    rows = hits.join(years, "doc", "left")
    year = F.coalesce(_int(g[3]), F.when(F.col("lo_y") == F.col("hi_y"), F.col("lo_y")))
    hour = _int(g[4]) % 12 + F.when(F.lower(g[6]) == "p", 12).otherwise(0)
    at = F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d:00", year, month.cast("int"), _int(g[2]), F.coalesce(hour, F.lit(0)), F.coalesce(_int(g[5]), F.lit(0))), F.lit("yyyy-MM-dd HH:mm:ss"))
    utc = F.unix_micros(F.to_utc_timestamp(at, zone))
    moment, about = g[4] != "", F.col("said").rlike(r"(?i)\babout\b")
    kind = F.when(year.isNull(), "unread").when(at.isNull(), "unread").when(moment, "moment").otherwise("day")
    slack = F.when(about, 8 * 60_000_000).otherwise(0)
    lo = F.when(kind == "moment", utc - slack).when(kind == "day", utc)
    hi = F.when(kind == "moment", utc + 60_000_000 + slack).when(kind == "day", F.unix_micros(F.to_utc_timestamp(at + F.expr("INTERVAL 1 DAY"), zone)))
    return rows.select("doc", "para", "said", kind.alias("kind"), lo.alias("lo_us"), hi.alias("hi_us"))
