"""Predicates over records that several operators share. None of them is ever null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def in_window(us: Column, lo: Column, hi: Column) -> Column:
    """Closed on both ends; an unknown time is never inside."""
    return never_null(us.between(lo, hi))


def channel_ok(kind: Column, app: Column, channels: Column) -> Column:
    """No channel stated admits all; 'call' admits any call; else the app, trimmed, any case."""
    stated = F.transform(channels, lambda c: F.lower(F.trim(c)))
    return (F.size(channels) == 0) | ((kind == "call") & F.array_contains(stated, "call")) | F.array_contains(stated, F.lower(F.trim(app)))


def opposite_sides(sender: Column, recipients: Column, a: Column, b: Column) -> Column:
    """Sent by one party to the other; a null sender is no party."""
    known = F.filter(recipients, lambda r: r.isNotNull())
    return never_null(
        (F.array_contains(a, sender) & F.arrays_overlap(known, b)) | (F.array_contains(b, sender) & F.arrays_overlap(known, a))
    )


def embedded_copy(locator: Column) -> Column:
    """A record that is only shown inside another one."""
    return never_null(locator.ilike("%/Embedded[%"))
