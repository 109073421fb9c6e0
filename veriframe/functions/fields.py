"""Cells of a report as typed values; what is not understood is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of direction and deletion cells, and zone names that an offset is checked against.
MESSAGE_IN, MESSAGE_OUT = ("incoming", "received", "inbox", "in"), ("outgoing", "sent", "outbox", "out")
CALL_IN, CALL_OUT, CALL_MISSED = ("incoming", "received"), ("outgoing", "dialed", "dialled"), ("missed",)
DELETED, KEPT = ("yes", "true", "deleted", "1"), ("no", "false", "intact", "0")
ZONES = (
    ("eastern time (us & canada)", "America/New_York"), ("central time (us & canada)", "America/Chicago"), ("mountain time (us & canada)", "America/Denver"),
    ("arizona", "America/Phoenix"), ("pacific time (us & canada)", "America/Los_Angeles"), ("alaska", "America/Anchorage"), ("hawaii", "Pacific/Honolulu"), ("coordinated universal time", "UTC"),
)


def _word(c: Column) -> Column:
    return F.element_at(F.split(F.lower(F.trim(c)), r"\s+"), 1)


def message_direction(c: Column) -> Column:
    w = _word(c)
    return F.when(w.isin(*MESSAGE_IN), "incoming").when(w.isin(*MESSAGE_OUT), "outgoing")


def call_direction(c: Column) -> Column:
    w = _word(c)
    return F.when(w.isin(*CALL_IN), "incoming").when(w.isin(*CALL_OUT), "outgoing").when(w.isin(*CALL_MISSED), "missed")


def deleted_flag(c: Column) -> Column:
    w = F.lower(F.trim(c))
    return F.when(w.isin(*DELETED), True).when(w.isin(*KEPT), False)


def is_forwarded(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)\b(auto-?)?forward(ed)?\b"), F.lit(False))


def offset_minutes(c: Column) -> Column:
    """'+5', '-05:00' and '+0530' as minutes; an empty offset is 0."""
    t = F.regexp_replace(c, r"[\s:]", "")
    digits = F.substring(t, 2, 10)
    short = F.length(digits) <= 2
    hours = F.when(short, digits).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 2)).try_cast("int")
    minutes = F.when(short, 0).otherwise(F.right(digits, F.lit(2)).try_cast("int"))
    return F.when(c.isNull() | (t == ""), 0).otherwise((hours * 60 + minutes) * F.when(t.startswith("-"), -1).otherwise(1))


def zone_name(c: Column) -> Column:
    """A zone's own name from a device's text: as given with a region, ``(UTC-05:00) City
    (Region)``, or a known display name; null if it names none."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    offset = r"^\((?:UTC|GMT)(?:[+-]\d{1,2}:\d{2})?\)\s*"
    city = F.regexp_extract(t, offset + r"([A-Za-z_/\-]+) \(([A-Za-z_/]+)\)$", 1)
    region = F.regexp_extract(t, offset + r"([A-Za-z_/\-]+) \(([A-Za-z_/]+)\)$", 2)
    shown = F.lower(F.regexp_replace(t, offset, ""))
    known = F.create_map(*[F.lit(x) for pair in ZONES for x in pair])
    return F.when(t.rlike(r"^[A-Za-z_]+/[A-Za-z_/\-]+$"), t).when(city != "", F.concat_ws("/", region, city)).otherwise(F.element_at(known, shown))


def short_hash(*fields: Column) -> Column:
    """The first 12 hex digits over the fields as a JSON array."""
    return F.left(F.sha2(F.to_json(F.array(*fields)), 256), F.lit(12))


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))


def digits_preserved(original: Column, translated: Column) -> Column:
    """Whether both texts hold the same numbers."""
    a, b = digit_runs(original), digit_runs(translated)
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def seeded_draw(seed: str, key: Column, rate: float) -> Column:
    """A repeatable draw that is true for about ``rate`` of the keys."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16), 16, 10).cast("double")
    return h / float(1 << 64) < rate
