"""The dates and times that paragraphs state, and the records their quotes and numbers tie to them.

A paragraph is one row: its dates and times of day are cut out by one pattern, told apart and read
by built-in functions on the array of what was found, so nothing but the years of a document is
shuffled. What cannot be read in one way only is listed with its reason and never compared.

* A date without a year takes that of the other end of its range, else the one year its paragraph
  names, else the one year its document names.
* 3/25/2026 reads in one way, 3/5/2026 in two: both readings are listed.
* A time of day belongs to the date it stands beside; "about" is ``ABOUT_MIN`` minutes either side.
* Dates inside quoted words are the quoted message's and are skipped; their years count.

Nulls: a null text states nothing. A repeated row is read as often as it stands. Offsets are code
points from 0, the end outside. Starts and ends are wall-clock times, the end outside; null is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import alias_key, contains_aligned
from veriframe.operators import audit
from veriframe.operators.matching import last_ten
from veriframe.operators.quotes import _anchored
from veriframe.operators.statements import SECOND, closest_ties, compare_times, nearest_stated, relation, row_status

# Minutes that "about" gives either side; records shown of a quote or number, and near
# a moment that nothing ties.
ABOUT_MIN, MOST_TIED, MOST_NEAR = 8, 4, 6

# Names of months, weekdays and zones, and words around a date or time.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "mon tue wed thu fri sat sun".split()
ZONES = {
    "utc": "UTC", "gmt": "UTC", "est": "Etc/GMT+5", "edt": "Etc/GMT+4", "cst": "Etc/GMT+6", "cdt": "Etc/GMT+5", "mst": "Etc/GMT+7", "mdt": "Etc/GMT+6",
    "pst": "Etc/GMT+8", "pdt": "Etc/GMT+7", "et": "America/New_York", "eastern": "America/New_York", "ct": "America/Chicago", "central": "America/Chicago",
    "mt": "America/Denver", "mountain": "America/Denver", "pt": "America/Los_Angeles", "pacific": "America/Los_Angeles",
}
_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
_WEEKDAY = "monday|tuesday|wednesday|thursday|friday|saturday|sunday|thurs|tues|thur|mon|tue|wed|thu|fri|sat|sun"
_HALF = r"[ap]\.?\s?m\.?(?![a-z])"
_ZONE = "|".join(ZONES)
_ABOUT = r"about|approximately|approx\.|around|roughly|circa"
_DASH = "[-–—]"
_TO = f"{_DASH}|to|through|thru|until|till"

_NAMED = (
    rf"(?:\b(?:{_WEEKDAY})\.?,?\s+)?\b(?:{_MONTH})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?![\d:/])(?!\s*{_HALF})"
    rf"(?:\s*{_DASH}\s*\d{{1,2}}(?![\d:/])(?!\s*{_HALF}))?(?:,?\s+\d{{4}}(?!\d))?"
)
_ISO = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
_NUMERIC = r"(?<![\d/.])\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})(?![\d/])"
_CLOCK = (
    rf"(?:\b(?:{_ABOUT})\s+)?(?:\b\d{{1,2}}(?::[0-5]\d)?\s*{_HALF}|\b(?:[01]?\d|2[0-3]):[0-5]\d(?![\d:])(?!\s*{_HALF})|\b(?:noon|midnight)\b)"
    rf"(?:\s*\(?\s*(?:{_ZONE})\b\)?(?:\s+time\b)?)?"
)
_FOUND = f"(?iU){_NAMED}|{_ISO}|{_NUMERIC}|{_CLOCK}"
# the parts of what was found
_NAMED_PARTS = rf"(?iU)^(?:({_WEEKDAY})\.?,?\s+)?({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*{_DASH}\s*(\d{{1,2}}))?(?:,?\s+(\d{{4}}))?$"
_ISO_PARTS = r"^(\d{4})-(\d{2})-(\d{2})$"
_NUMERIC_PARTS = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
_CLOCK_PARTS = rf"(?iU)^(?:({_ABOUT})\s+)?(?:(\d{{1,2}})(?::([0-5]\d))?\s*([ap])\.?\s?m\.?|(\d{{1,2}}):([0-5]\d)|(noon|midnight))(?:\s*\(?\s*({_ZONE})\b\)?(?:\s+time\b)?)?$"
_BARE_HOUR = r"(?iU)\b(\d{1,2})(?::([0-5]\d))?\s+(?:and|to|-|–)\s+$"
_YEAR = r"(?<!\d)((?:19|20)\d\d)(?!\d)"
# Where a sentence ends, and the full stops that end none.
_NO_END = r"(?i:\b[ap]\.\s?m\.|\b(?:Mr|Mrs|Ms|Dr|No|St|Jr|Sr|Inc|Co|Ave|approx)\.|\b[A-Z]\.)"
_SENTENCE_END = rf"(?<=[.!?])(?<!{_NO_END})([\"”]?)"
_SENTENCE_NEXT = r"(?=[\"“(]?[A-Z0-9])"
# Words of calls, and a telephone number.
_CALL = r"(?i)\b(?:call|calls|called|calling|phoned|dialed|dialled|rang)\b"
_NUMBER = r"(?<!\w)\+?\d[\d ().\-]{7,}\d(?!\w)"

_MARK, _FILL = "\u0001", "\u0002"
_BEFORE_LEN, _BLOCK, _REACH = 48, 256, 256
COMPARED = ("moment", "day", "range", "open")


# ----------------------------------------------------------------- places in a text
def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _MARK, _FILL)


def masked(text: Column) -> Column:
    """The text with quoted words filled up, as long as before."""
    pieces = F.regexp_extract_all(text, F.lit(r"\"[^\"]+\"|“[^”]+”|[^\"“]+|[\"“]"), F.lit(0))
    quoted = lambda p: F.left(p, F.lit(1)).isin('"', "“") & (F.length(p) > 1)
    fill = lambda p: F.concat(F.left(p, F.lit(1)), F.repeat(F.lit(_FILL), F.length(p) - 2), F.right(p, F.lit(1)))
    return F.array_join(F.transform(pieces, lambda p: F.when(quoted(p), fill(p)).otherwise(p)), "")


def _parted(text: Column, pattern: str) -> Column:
    """[what stands before, a match, what stands between, a match, ...]"""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)


def _sums(sizes: Column) -> Column:
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.get(acc, F.size(acc) - 1) + n))


def offsets(sizes: Column) -> Column:
    """Where each of the pieces begins; in blocks, so that a long text costs little more than its length."""
    last = F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: _sums(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))))
    bases = F.slice(_sums(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1))), F.lit(1), last + 1)
    shifted = F.zip_with(bases, blocks, lambda base, b: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda n: n + base))
    return F.flatten(shifted)


def _sizes(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.length(p))


def sentence_spans(text: Column) -> Column:
    """[(a, b, calls)]: the sentences of a text and whether words of a call stand in them."""
    parts = F.split(F.regexp_replace(text, rf"(?U){_SENTENCE_END}(\s+){_SENTENCE_NEXT}", f"$1{_MARK}$2{_MARK}"), _MARK)
    at = offsets(_sizes(parts))
    spans = F.zip_with(parts, at, lambda p, a: F.struct(a.alias("a"), (a + F.length(p)).alias("b"), p.rlike(_CALL).alias("calls")))
    return F.filter(spans, lambda x, i: i % 2 == 0)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.when(y >= 1, F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date"))


def _text(c: Column) -> Column:
    return F.when(c != "", c)


# ------------------------------------------------------------------ what was found
def _half_day(h: Column, m: Column, half: Column) -> Column:
    """Minutes of the day, null if the hour is none of a half day."""
    return F.when(h.between(1, 12), (h % 12 + F.when(F.lower(half) == "p", 12).otherwise(0)) * 60 + F.coalesce(m, F.lit(0)))


def _fields(pattern: str, kind: str, n: int) -> tuple[str, str]:
    """A pattern, and what puts its kind and groups in its place with marks between."""
    return pattern, _MARK.join([kind, *(f"${k}" for k in range(1, n + 1))])


_FIELDS = (_fields(_NAMED_PARTS, "named", 5), _fields(_ISO_PARTS, "iso", 3), _fields(_NUMERIC_PARTS, "numeric", 3), _fields(_CLOCK_PARTS, "clock", 8))


def _cut(said: Column, start: Column, gap: Column, before: Column) -> Column:
    """What was found with its kind and parts, each pattern tried once."""
    parts = said
    for pattern, put in _FIELDS:
        parts = F.regexp_replace(parts, pattern, put)
    return F.struct(said.alias("said"), start.alias("s"), gap.alias("gap"), before.alias("before"), F.split(parts, _MARK).alias("p"), F.regexp_extract(F.right(before, F.lit(16)), _BARE_HOUR, 0).alias("bare"))


def _typed(x: Column) -> Column:
    """The parts as numbers and dates."""
    p = lambda k: F.get(x.p, F.lit(k))
    is_ = lambda kind: p(0) == kind
    digits = lambda k: F.split_part(F.regexp_replace(F.trim(x.bare), r"(?U)\s.*", ""), F.lit(":"), F.lit(k))
    clock, half = is_("clock"), is_("clock") & (p(4) != "")
    at = F.when(p(7) != "", F.when(F.lower(p(7)) == "noon", 720).otherwise(0)).when(half, _half_day(_int(p(2)), _int(p(3)), p(4))).otherwise(_int(p(5)) * 60 + _int(p(6)))
    bare_met = half & (x.bare != "")
    month_first = F.when(is_("iso"), _date(_int(p(1)), _int(p(2)), _int(p(3)))).when(is_("numeric"), _date(_int(p(3)), _int(p(1)), _int(p(2))))
    return F.struct(
        x.said.alias("said"), x.s.alias("s"), x.gap.alias("gap"), x.before.alias("before"), p(0).alias("kind"), x.p.alias("p"), F.length(x.bare).alias("bare_length"), F.coalesce(bare_met, F.lit(False)).alias("bare"),
        month_first.alias("md"), F.when(is_("numeric"), _date(_int(p(3)), _int(p(2)), _int(p(1)))).alias("dm"), (is_("numeric") & (F.length(p(3)) == 2)).alias("short"),
        F.when(clock, at).alias("at"), F.when(bare_met, _half_day(_int(digits(1)), _int(digits(2)), p(4))).alias("bare_at"),
    )


def _read(x: Column) -> Column:
    """One date or time of day as it stands, not yet tied to anything."""
    p = lambda k: F.get(x.p, F.lit(k))
    named, clock, full = x.kind == "named", x.kind == "clock", (x.kind == "numeric") & ~x.short
    either, fixed = full & (x.md != x.dm), F.when(~x.short, F.coalesce(x.md, x.dm))
    problem = F.when(x.short, "two_digit_year").when(either, "either_order").when(full & fixed.isNull(), "no_date")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.left(F.lower(p(2)), F.lit(3))).cast("int")
    ranged = F.coalesce(x.bare_at < x.at, F.lit(False))
    return F.struct(
        x.said.alias("said"), x.s.alias("s"), (x.s + F.length(x.said)).alias("e"), x.gap.alias("gap"), x.before.alias("before"),
        (~clock).alias("is_date"), (clock & x.at.isNotNull()).alias("is_time"), problem.alias("problem"), F.when(either, F.array(x.md, x.dm)).alias("readings"),
        F.when(named, _int(p(5))).otherwise(F.coalesce(F.year(fixed), F.lit(0))).alias("year"), F.when(named, month).otherwise(F.month(fixed)).alias("month"), F.when(named, _int(p(3))).otherwise(F.day(fixed)).alias("day"),
        F.when(named, _int(p(4))).alias("day2"), F.when(named, _text(p(1))).alias("weekday"), F.when(ranged, x.bare_at).otherwise(x.at).alias("at"), F.when(ranged, x.at).alias("end_at"),
        (clock & (p(1) != "")).alias("about"), F.when(clock, _text(p(8))).alias("zone"), x.bare.alias("bare"), F.when(ranged, x.bare_length).otherwise(0).alias("lead"),
    )


def _found(paragraphs: DataFrame) -> DataFrame:
    """(doc, para_id, year, years, length, sentences, found): the dates and times of each paragraph that has any."""
    t = paragraphs.select("doc", "para_id", _clean(F.col("text")).alias("text"))
    t = t.withColumn("parts", _parted(masked(F.col("text")), _FOUND)).filter(F.size("parts") > 1)
    t = t.withColumn("at", offsets(_sizes(F.col("parts"))))

    def one(k: Column) -> Column:
        start = F.get("at", 2 * k - 1)
        width = F.least(start, F.lit(_BEFORE_LEN))
        return _cut(F.get("parts", 2 * k - 1), start, F.get("parts", 2 * k), F.substring(F.col("text"), start - width + 1, width))

    years = F.array_distinct(F.regexp_extract_all("text", F.lit(_YEAR), F.lit(1)))
    n = F.floor(F.size("parts") / 2).cast("int")
    return t.select("doc", "para_id", years.alias("years"), F.length("text").alias("length"), sentence_spans(F.col("text")).alias("sentences"), F.transform(F.transform(F.transform(F.sequence(F.lit(1), n), one), _typed), _read).alias("found"))


def _linked(t: DataFrame) -> DataFrame:
    """``found`` as items: two dates that make a range and two times that make one are one item."""

    def flags(x: Column, i: Column) -> Column:
        prev, nxt = F.get("found", i - 1), F.get("found", i + 1)
        gap = F.when(i > 0, prev.gap)
        between = F.regexp_extract(F.right(prev.before, F.lit(24)), r"(?iU)\b(?:between|from)\s+$", 0) != ""
        dates = prev.is_date & x.is_date & (gap.rlike(rf"(?iU)^\s*(?:{_TO})\s*$") | (gap.rlike(r"(?iU)^\s*and\s*$") & between))
        times = prev.is_time & x.is_time & prev.end_at.isNull() & ~x.bare & gap.rlike(rf"(?iU)^\s*(?:{_TO}|(?-i:and))\s*$")
        rest = F.when(nxt.lead <= F.length(x.gap), F.left(x.gap, F.length(x.gap) - nxt.lead))
        no = F.lit(False)
        return x.withField("link", F.coalesce(dates | times, no)).withField("to_date", F.coalesce(x.gap.rlike(r"(?iU)^\s*,?\s*(?:on\s+)?$"), no)).withField("to_time", F.coalesce(rest.rlike(r"(?iU)^\s*,?\s*(?:at\s+)?$"), no))

    t = t.withColumn("found", F.transform("found", flags))
    took = F.aggregate("found", F.array().cast("array<boolean>"), lambda acc, x: F.array_append(acc, x.link & ~F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(False))))
    t = t.withColumn("took", took)

    def item(x: Column, i: Column) -> Column:
        # gaps that join nothing stay behind: the rows that go on are short
        b = F.when(F.coalesce(F.get("took", i + 1), F.lit(False)), F.get("found", i + 1))
        last = F.coalesce(b, x)
        raw = F.when(b.isNotNull(), F.concat(x.said, x.gap, b.said)).otherwise(x.said)
        return F.struct(
            x.withField("gap", F.lit("")).alias("a"), b.withField("gap", F.lit("")).withField("before", F.lit("")).alias("b"), raw.alias("raw"), last.e.alias("e"),
            F.when(last.to_date | last.to_time, last.gap).otherwise("").alias("gap"), last.to_date.alias("to_date"), last.to_time.alias("to_time"), F.get("took", i).alias("took"),
        )

    return t.withColumn("items", F.filter(F.transform("found", item), lambda x: ~x.took)).drop("found", "took")


# ----------------------------------------------------------------------- reading
def document_years(paragraphs: DataFrame) -> DataFrame:
    """(doc, first_year, last_year): the years a document names anywhere, quoted words included."""
    years = F.regexp_extract_all("text", F.lit(_YEAR), F.lit(1))
    return paragraphs.select("doc", years.alias("years")).filter(F.size("years") > 0).groupBy("doc").agg(F.min(F.array_min("years")).cast("int").alias("first_year"), F.max(F.array_max("years")).cast("int").alias("last_year"))


def stated(paragraphs: DataFrame) -> DataFrame:
    """Every date and time that paragraphs state, in reading order.

    paragraphs: doc, para_id, text. Returns doc, para_id, n (from 1 in a paragraph), raw, start_i,
    end_i, sentence_start, sentence_end, of_call (words of a call stand in the sentence), kind
    (moment, day, range, open, ambiguous, unread), start, end, about, on_or_about, zone (null: none
    stated), weekday_ok (null: no weekday stated), readings, note (why it is not read: two_digit_year,
    either_order, no_date, no_year, several_years, range_reversed, no_range, no_date_beside).
    A range of times that ends before it begins is kept as it stands: no record is inside.
    """
    t = _linked(_found(paragraphs)).join(document_years(paragraphs), "doc", "left")
    pool = F.when(F.size("years") == 1, _int(F.get("years", F.lit(0)))).when((F.size("years") == 0) & (F.col("first_year") == F.col("last_year")), F.col("first_year"))
    t = t.withColumn("year", pool).withColumn("many", (F.size("years") > 1) | F.coalesce(F.col("first_year") < F.col("last_year"), F.lit(False)))

    def resolved(x: Column) -> Column:
        def on(d: Column, other: Column) -> Column:
            y = F.coalesce(d.year, other.year, F.col("year"))
            at = F.when(d.problem.isNull(), _date(y, d.month, d.day))
            why = F.coalesce(d.problem, F.when(y.isNull(), F.when(F.col("many"), "several_years").otherwise("no_year")).when(at.isNull(), "no_date"))
            return F.when(d.is_date, F.struct(at.alias("at"), why.alias("why")))

        d1, d2 = on(x.a, x.b), F.when(x.b.isNotNull(), on(x.b, x.a))
        day = x.a.is_date & x.b.isNull() & x.a.day2.isNull() & d1.at.isNotNull()
        return x.withField("d1", d1).withField("d2", d2).withField("day", F.coalesce(day, F.lit(False)))

    t = t.withColumn("items", F.transform("items", resolved))

    # a day takes the time before it, unless the day before that has it, else the time after it
    def take(acc: Column, i: Column) -> Column:
        x, prev, nxt = F.get("items", i), F.get("items", i - 1), F.get("items", i + 1)
        behind = x.day & prev.a.is_time & prev.to_date & ~F.coalesce(F.get(acc, i - 2) == 2, F.lit(False))
        ahead = x.day & nxt.a.is_time & x.to_time
        return F.array_append(acc, F.when(behind, 1).when(ahead, 2).otherwise(0))

    at = F.sequence(F.lit(0), F.size("items") - 1)
    t = t.withColumn("side", F.aggregate(at, F.array().cast("array<int>"), take))
    with_time = lambda x, i: x.withField("side", F.get("side", i)).withField("t", F.when(F.get("side", i) == 1, F.get("items", i - 1)).when(F.get("side", i) == 2, F.get("items", i + 1))).withField("used", F.coalesce(F.get("side", i + 1) == 1, F.lit(False)) | F.coalesce(F.get("side", i - 1) == 2, F.lit(False)))
    kept = F.filter(F.transform("items", with_time), lambda x: x.a.is_date | (x.a.is_time & ~x.used))
    # outer: an inner explode would have all of its input computed once more to look for empty arrays
    rows = t.select("doc", "para_id", "length", "sentences", F.posexplode_outer(kept).alias("pos", "x")).filter("pos IS NOT NULL")
    return _placed(_valued(rows))


def _valued(rows: DataFrame) -> DataFrame:
    """The items' kinds, starts and ends, before what words stand ahead of them."""
    a, b, t, d1, d2 = (F.col(f"x.{k}") for k in ("a", "b", "t", "d1", "d2"))
    midnight = lambda d, days=0: F.date_add(d, days).cast("timestamp_ntz")
    minutes = lambda m: F.make_dt_interval(mins=m)
    pair = b.isNotNull() & a.is_date
    in_month = _date(F.year(d1.at), F.month(d1.at), a.day2)
    no_range = a.day2.isNotNull() & (in_month.isNull() | (in_month < d1.at))
    readings = F.when(a.is_date, F.array_compact(F.concat(F.coalesce(a.readings, F.array().cast("array<date>")), F.coalesce(b.readings, F.array().cast("array<date>")))))
    note = (
        F.when(a.is_time, "no_date_beside").when(F.size(readings) > 0, F.coalesce(a.problem, b.problem)).when(pair, F.coalesce(d1.why, d2.why, F.when(d2.at < d1.at, "range_reversed")))
        .otherwise(F.coalesce(d1.why, F.when(no_range, "no_range")))
    )
    kind = F.when(F.size(readings) > 0, "ambiguous").when(note.isNotNull(), "unread").when(pair | a.day2.isNotNull(), "range").when(t.isNotNull(), "moment").otherwise("day")
    about, slack = t.a.about | F.coalesce(t.b.about, F.lit(False)), minutes(F.lit(ABOUT_MIN))
    last = F.coalesce(t.a.end_at, t.b.at)
    begin, end = midnight(d1.at) + minutes(t.a.at), midnight(d1.at) + minutes(F.coalesce(last, t.a.at + 1))
    moment = F.col("kind") == "moment"
    start = F.when(moment, F.when(about, begin - slack).otherwise(begin)).when(F.col("kind").isin("day", "range"), midnight(d1.at))
    stop = F.when(moment, F.when(about, end + slack).otherwise(end)).when(F.col("kind") == "day", midnight(d1.at, 1)).when(F.col("kind") == "range", midnight(F.coalesce(d2.at, in_month), 1))
    weekday = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.left(F.lower(a.weekday), F.lit(3))) - 1
    rows = rows.withColumns({"kind": kind, "note": note, "readings": F.when(F.size(readings) > 0, readings)})
    # the words ahead: those of the time where it stands first, and what belongs to it
    head = F.when(F.col("x.side") == 1, t.a).otherwise(a)
    range_lead = F.when(pair, F.length(F.regexp_extract(F.right(a.before, F.lit(24)), r"(?iU)\b(?:between|from)\s+$", 0))).otherwise(0)
    at_lead = F.when(F.col("x.side") == 1, F.length(F.regexp_extract(F.right(F.left(head.before, F.length(head.before) - head.lead), F.lit(4)), r"(?iU)\bat\s+$", 0))).otherwise(0)
    own = F.when(F.col("x.side") == 1, F.concat(t.raw, t.gap, "x.raw")).when(F.col("x.side") == 2, F.concat("x.raw", "x.gap", t.raw)).otherwise(F.col("x.raw"))
    return rows.withColumns({
        "start": start, "end": stop, "about": F.coalesce(moment & about, F.lit(False)), "zone_words": F.when(moment, F.coalesce(t.b.zone, t.a.zone)),
        "weekday_ok": F.when(a.is_date & b.isNull() & d1.at.isNotNull() & (F.col("kind") != "ambiguous"), F.weekday(d1.at) == weekday),
        "lead": range_lead + head.lead + at_lead, "before": head.before, "s": head.s, "e": F.when(F.col("x.side") == 2, t.e).otherwise(F.col("x.e")), "own": own,
    })


def _placed(rows: DataFrame) -> DataFrame:
    """Open ends by the words ahead, and the sentence."""
    ahead = F.right(F.left("before", F.length("before") - F.col("lead")), F.lit(20))
    on_or_about = F.regexp_extract(ahead, r"(?iU)\bon or about\s+$", 0)
    opening = r"(?iU)\b(on or before|on or after|before|prior to|until|up to|after|since|from)\s+$"
    word, whole = F.lower(F.regexp_extract(ahead, opening, 1)), F.regexp_extract(ahead, opening, 0)
    read = F.col("kind").isin("day", "range", "moment")
    about = read & (on_or_about != "")
    opens = read & ~about & (word != "") & ~((word == "from") & (F.col("kind") == "range"))
    lead = F.col("lead") + F.when(about, F.length(on_or_about)).when(opens, F.length(whole)).otherwise(0)
    rows = rows.withColumns({"on_or_about": about, "open": F.when(opens, word), "all_lead": lead})
    w = F.col("open")
    start = F.when(w == "after", F.col("end")).when(w.isin("since", "from", "on or after"), F.col("start")).when(w.isNull(), F.col("start"))
    end = F.when(w.isin("before", "prior to"), F.col("start")).when(w.isin("on or before", "until", "up to"), F.col("end")).when(w.isNull(), F.col("end"))
    start_i = F.col("s") - F.col("all_lead")
    rows = rows.withColumns({"start_i": start_i, "new_start": start, "new_end": end})
    over = F.filter("sentences", lambda x: (x.a < F.col("e")) & (F.col("start_i") < x.b))
    zones = F.create_map(*[F.lit(v) for pair in ZONES.items() for v in pair])
    return rows.withColumn("over", over).select(
        "doc", "para_id", (F.col("pos") + 1).alias("n"), F.concat(F.right("before", F.col("all_lead")), "own").alias("raw"), "start_i", F.col("e").alias("end_i"),
        F.coalesce(F.get("over", F.lit(0)).a, F.lit(0)).alias("sentence_start"), F.coalesce(F.get("over", F.size("over") - 1).b, F.col("length")).alias("sentence_end"),
        F.exists("over", lambda x: x.calls).alias("of_call"), F.when(w.isNotNull(), "open").otherwise(F.col("kind")).alias("kind"), F.col("new_start").alias("start"), F.col("new_end").alias("end"),
        "about", "on_or_about", F.when(F.col("zone_words").isNotNull(), zones[F.lower("zone_words")]).alias("zone"), "weekday_ok", "readings", "note",
    )


# ------------------------------------------------------------------------- ties
def numbers(paragraphs: DataFrame) -> DataFrame:
    """(para_id, start, words): what reads as a telephone number outside quoted words and has ten digits; none goes beyond its sentence."""
    one_blank = rf"(?U){_SENTENCE_END}\s(?=\s*[\"“(]?[A-Z0-9])"
    cut = masked(F.regexp_replace(_clean(F.col("text")), one_blank, f"$1{_FILL}"))
    t = paragraphs.select("para_id", _parted(cut, f"(?U){_NUMBER}").alias("parts")).filter(F.size("parts") > 1).withColumn("at", offsets(_sizes(F.col("parts"))))
    found = F.filter(F.arrays_zip("at", "parts"), lambda x, i: i % 2 == 1)
    rows = t.select("para_id", F.explode_outer(found).alias("x")).filter("x IS NOT NULL").select("para_id", F.col("x.at").alias("start"), F.col("x.parts").alias("words"))
    return rows.filter(F.length(F.regexp_replace("words", r"\D", "")) >= 10)


def _in_sentences(marks: DataFrame, times: DataFrame) -> DataFrame:
    """(mark columns, sentence_id): the sentences with a time that a mark begins in, met by stretches of ``_REACH`` characters."""
    sentences = times.groupBy("para_id", "sentence_start").agg(F.min_by("sentence_end", "n").alias("sentence_end"), F.bool_or("of_call").alias("of_call"))
    stretch = F.sequence(F.floor(F.col("sentence_start") / _REACH), F.floor(F.greatest(F.col("sentence_end") - 1, "sentence_start") / _REACH))
    spread = sentences.select("para_id", "sentence_start", "sentence_end", "of_call", F.explode(stretch).alias("stretch"))
    met = marks.withColumn("stretch", F.floor(F.col("start") / _REACH)).join(spread, ["para_id", "stretch"])
    inside = (F.col("sentence_start") <= F.col("start")) & (F.col("start") < F.col("sentence_end")) & ((F.col("how") == "quote") | F.col("of_call"))
    return met.filter(inside).select(*marks.columns, F.struct("para_id", "sentence_start").alias("sentence_id"))


def marks(paragraphs: DataFrame, times: DataFrame, names: DataFrame) -> DataFrame:
    """(mark_id, stated_id, how, words, relation): the quotes of two words or more that are no name, and
    the telephone numbers beside words of a call, each with the stated time of its sentence that stands
    closest to it and how it lies to that time.

    paragraphs: para_id (unique), text; times: from ``stated``; names: name.
    """
    known = names.select(alias_key(F.col("name")).alias("key")).filter("key <> ''").distinct()
    quoted = audit.paragraph_quotes(paragraphs).filter(F.size(F.split("words", " ")) >= 2)
    quoted = quoted.withColumn("key", alias_key(F.col("words"))).join(known, "key", "left_anti")
    both = quoted.select("para_id", "start", "words", F.lit("quote").alias("how")).unionByName(numbers(paragraphs).withColumn("how", F.lit("number")))
    compared = times.filter(F.col("kind").isin(*COMPARED))
    placed = _in_sentences(both, compared).withColumn("quote_id", F.struct("para_id", "start", "how", "sentence_id")).withColumnRenamed("start", "pos")
    places = compared.select("para_id", F.struct("para_id", "n").alias("stated_id"), F.struct("para_id", "sentence_start").alias("sentence_id"), "start_i", "end_i")
    nearest = nearest_stated(placed, places.select("stated_id", "sentence_id", "start_i", "end_i"))
    rows = placed.join(nearest, "quote_id").join(places.select("stated_id", "start_i", "end_i"), "stated_id")
    rows = rows.join(paragraphs.select("para_id", _clean(F.col("text")).alias("text")), "para_id")
    a, b = F.least("end_i", "pos"), F.greatest("end_i", "pos")
    said = relation(F.substring(F.col("text"), a + 1, b - a), F.col("pos") > F.col("start_i"))
    return rows.select(F.col("quote_id").alias("mark_id"), "stated_id", "how", "words", said.alias("relation"))


def tied(marked: DataFrame, records: DataFrame) -> DataFrame:
    """(how, words, id): messages that hold a quote's words as they stand, word-aligned, and calls with a
    party whose last ten digits are the number's; once for the same words of many marks.

    records: id, kind (message, call), text, parties (array of identifiers).
    """
    quotes = marked.filter("how = 'quote'").select(F.col("words").alias("quote_id"), F.col("words").alias("quote")).distinct()
    bodies = records.filter("kind = 'message' AND text IS NOT NULL").select("id", F.col("text").alias("body"))
    held = _anchored(quotes, bodies).filter(contains_aligned(F.col("body"), F.col("quote"))).select(F.lit("quote").alias("how"), F.col("quote").alias("words"), "id")
    parties = records.filter("kind = 'call'").select("id", F.explode("parties").alias("party")).select("id", last_ten(F.col("party")).alias("tail")).filter("tail IS NOT NULL").distinct()
    asked = marked.filter("how = 'number'").select("how", "words", last_ten(F.col("words")).alias("tail")).distinct()
    return held.unionByName(asked.join(parties, "tail").select("how", "words", "id"))


def utc(start: Column, end: Column, zone: Column) -> tuple[Column, Column]:
    """A wall-clock range in a zone as half-open microseconds; null where it is open or the zone unknown."""
    at = lambda c: F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), zone))
    return at(start), at(end)


def compared(marked: DataFrame, found: DataFrame, times: DataFrame, records: DataFrame, tolerance_s: int = 300) -> DataFrame:
    """(stated_id, mark_id, how, relation, id, state, delta_us, conflict, no, total): for each mark the
    ``MOST_TIED`` records closest to its stated time, and how many there are; a mark without a record
    has one row without an id. A time without a zone is read in the record's own. Marks of the same
    words, relation and time are compared once. found: of ``tied``.

    records: id, source_id, us, zone (null: unknown).
    """
    windows = times.select(F.struct("para_id", "n").alias("stated_id"), "start", "end", F.col("zone").alias("stated_zone"))
    marked = marked.join(windows, "stated_id").withColumn("ask", _key("how", "words", "relation", "start", "end", "stated_zone"))
    asks = marked.groupBy("ask").agg(*[F.first(c).alias(c) for c in ("how", "words", "relation", "start", "end", "stated_zone")])
    rows = asks.join(found, ["how", "words"]).join(records.select("id", "source_id", "us", F.col("zone").alias("own_zone")), "id")
    rows = rows.withColumn("zone", F.coalesce("stated_zone", "own_zone"))
    lo, hi = utc(F.col("start"), F.col("end"), F.col("zone"))
    held = compare_times(rows.withColumn("lo", lo).withColumn("hi", hi), tolerance_s).withColumn("quote_id", F.col("ask"))
    shown = closest_ties(held, MOST_TIED, "source_id", "state", "delta_us", "conflict").withColumnRenamed("quote_id", "ask")
    counted = found.groupBy("how", "words").agg(F.count("*").alias("total"))
    t = marked.join(counted, ["how", "words"], "left").join(shown, "ask", "left")
    return t.select("stated_id", "mark_id", "how", "words", "relation", "source_id", "id", "state", "delta_us", "conflict", "no", F.coalesce("total", F.lit(0).cast("long")).alias("total"))


def _key(*columns: str) -> Column:
    """One text for equal values, nulls among them."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))


def statuses(times: DataFrame, ties: DataFrame) -> DataFrame:
    """(para_id, n, status) of every stated time: not_compared if it could not be read, else as
    ``row_status`` says of its ties."""
    held = ties.withColumnRenamed("mark_id", "quote_id")
    ids = times.withColumn("stated_id", F.struct("para_id", "n"))
    t = ids.join(row_status(held, MOST_TIED, ids.select("stated_id", "weekday_ok")), "stated_id", "left")
    wrong_day = ~F.coalesce("weekday_ok", F.lit(True))
    untied = F.when(wrong_day, "weekday").otherwise("not_tied")
    return t.select("para_id", "n", F.when(~F.col("kind").isin(*COMPARED), "not_compared").otherwise(F.coalesce("status", untied)).alias("status"))


def near_untied(times: DataFrame, marked_found: DataFrame, records: DataFrame, tolerance_s: int = 300) -> DataFrame:
    """(stated_id, id, state, delta_us, no, total): for stated moments that no record ties to, the
    ``MOST_NEAR`` records inside them or within the tolerance, closest first, and how many there are.

    A moment with a zone meets records by UTC, one without by the wall clock of each record's own
    zone; both in buckets as wide as a moment and its tolerance, so each record and moment is sent a
    few times at most. records as for ``compared``; a record without time or zone is near nothing.
    """
    width = max(3600, 2 * tolerance_s) * SECOND  # equal moments of many paragraphs meet the records once
    wall = lambda c: F.unix_micros(c.cast("timestamp"))
    m = times.filter("kind = 'moment'").select(F.struct("para_id", "n").alias("stated_id"), "start", "end", F.col("zone").alias("stated_zone"))
    m = m.join(marked_found.filter("id IS NOT NULL").select("stated_id").distinct(), "stated_id", "left_anti")
    m = m.withColumn("moment", _key("start", "end", "stated_zone"))
    asking = m.select("stated_id", "moment")
    m = m.groupBy("moment").agg(*[F.first(c).alias(c) for c in ("start", "end", "stated_zone")])
    ends = F.when(F.col("stated_zone").isNull(), F.struct(wall(F.col("start")).alias("a"), wall(F.col("end")).alias("b"))).otherwise(F.struct(*[c.alias(k) for c, k in zip(utc(F.col("start"), F.col("end"), F.col("stated_zone")), "ab")]))
    # wall clocks may part by the hours of a change of clocks
    pad = F.when(F.col("stated_zone").isNull(), 7200 * SECOND).otherwise(0) + tolerance_s * SECOND
    m = m.withColumn("ends", ends).filter("ends.a <= ends.b").withColumn("bucket", F.explode(F.sequence(F.floor((F.col("ends.a") - pad) / width), F.floor((F.col("ends.b") + pad) / width))))
    m = m.withColumn("by_wall", F.col("stated_zone").isNull())
    r = records.filter("us IS NOT NULL AND zone IS NOT NULL").select("id", "source_id", "us", F.col("zone").alias("own_zone"))
    local = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("us"), F.col("own_zone")))
    r = r.withColumn("at", F.explode(F.array(F.struct(F.lit(True).alias("by_wall"), local.alias("v")), F.struct(F.lit(False).alias("by_wall"), F.col("us").alias("v")))))
    r = r.select("id", "source_id", "us", "own_zone", "at.by_wall", F.floor(F.col("at.v") / width).alias("bucket"))
    rows = m.join(r, ["by_wall", "bucket"]).withColumn("zone", F.coalesce("stated_zone", "own_zone"))
    lo, hi = utc(F.col("start"), F.col("end"), F.col("zone"))
    held = compare_times(rows.withColumns({"lo": lo, "hi": hi, "relation": F.lit("at")}), tolerance_s).filter(F.col("state").isin("inside", "within"))
    held = held.withColumn("quote_id", F.col("moment"))
    first = closest_ties(held, MOST_NEAR, "state", "delta_us").withColumnRenamed("quote_id", "moment")
    counted = held.groupBy("moment").agg(F.count("*").alias("total"))
    return asking.join(first.join(counted, "moment"), "moment").select("stated_id", "id", "state", "delta_us", "no", "total")
