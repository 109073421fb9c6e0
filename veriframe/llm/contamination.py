"""Benchmark decontamination (8): template windows, and the consistency of their slots.

A text becomes a template: numbers, names (capitalised words inside a sentence) and units after
a number turn into typed placeholders, the rest into lower-case words. Windows of ``WINDOW``
template words of the documents meet the windows of the benchmark items by hash. A document
that shows at least ``MIN_SHARE`` of an item's windows is a candidate. Then the slots under the
matched windows are compared: a re-parameterised question puts one value for each value of the
item, so a slot value of the item that meets several values speaks against it. A document may
hold an item several times with other values each time, so this is judged for each occurrence:
the matched windows of one alignment, and those of one run (the item's places do not fall back,
so words may be put in or left out), each if it shows ``MIN_SHARE`` of the item. All matched
windows of the document together are judged too, as an item may stand in scattered parts. The
candidate is cleared only if in every one of them more than ``MAX_CLASHES`` of the item's values
meet several values; an occurrence that changes no value always keeps it.

All of it is DataFrame expressions: the windows of a document are made inside its row and only
a hash and a place leave it; the benchmark's windows are broadcast while they are few
(``MAX_BROADCAST_WINDOWS``) and joined by a shuffle beyond. Texts are read again only for the
candidates.

Null and empty texts, of documents or items, match nothing. A window of placeholders only says
nothing and is left out of an item; an item without any other window matches nothing. An item
shorter than a window is matched as one window of its own length; one of less than ``MIN_WORDS``
template words is no evidence inside a text and matches only documents that consist of it.
Rows are known by their id and a hash of their text: different texts under one id and rows of a
null id are each judged by themselves, and rows equal in both alike. Private-use characters
U+E000 to U+E002 in a text are read as placeholders. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut, let, text_of

WINDOW, MIN_SHARE, MAX_CLASHES, MIN_WORDS = 8, 0.3, 0.25, 4
MAX_BROADCAST_WINDOWS = 500_000

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
_NUMBER = r"(?<![\p{L}\p{N}])[0-9]+(?:[.,][0-9]+)*"
_NAME = r"\p{Lu}(?<=[\p{Ll}\p{N},;" + NUMBER + r"] .)[\p{L}'’-]*"
# Units of measure and currency that may follow a number.
UNITS = (
    "km|m|cm|mm|miles?|feet|foot|ft|inch|inches|kg|g|mg|lb|lbs|pounds?|tons?|l|ml|litres?|liters?|hours?|hrs?|h|minutes?|min|"
    "seconds?|sec|s|days?|weeks?|months?|years?|percent|%|dollars?|euros?|usd|eur|degrees?|watts?|w|kw|volts?|v|hz|mph|kmh"
)
_UNIT = NUMBER + r"\s*-?\s*(" + UNITS + r")(?![\p{L}\p{N}])"


def _numbered(text: Column) -> Column:
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, _NUMBER, NUMBER + " ")).otherwise(text)


def _named(text: Column) -> Column:
    return F.regexp_replace(_numbered(text), _NAME, NAME)


def template(text: Column) -> Column:
    """The template words of a text."""
    named = F.lower(_named(text))
    full = F.when(named.contains(NUMBER), F.regexp_replace(named, _UNIT, f"{NUMBER} {UNIT} ")).otherwise(named)
    return F.array_remove(F.split(full, "[^\\p{L}\\p{N}\ue000-\ue002]+"), "")


def windows(words: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words."""
    return F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0))),
        lambda _, i: F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)]),
    )


def slots(text: Column) -> Column:
    """(place among the template words, kind, value) of every placeholder, in order."""
    lowered = F.lower(_named(text))
    values = {
        NUMBER: F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)),
        NAME: F.regexp_extract_all(_numbered(text), F.lit(_NAME), F.lit(0)),
        UNIT: F.regexp_extract_all(lowered, F.lit(_UNIT), F.lit(1)),
    }

    def of(words: Column, mark: str) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(w == mark, i).otherwise(-1)), lambda i: i >= 0)
        return F.zip_with(places, values[mark], lambda p, v: F.struct(p.alias("at"), F.lit(mark).alias("kind"), F.lower(v).alias("value")))

    return let(template(text), lambda words: F.filter(F.concat(*[of(words, m) for m in values]), lambda s: s.at.isNotNull() & s.value.isNotNull()))


def _row(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("tag"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, min_share: float = MIN_SHARE, max_clashes: float = MAX_CLASHES) -> DataFrame:
    """(doc, tag, item, share, n_slots, n_clashes, n_changed): every document that shows an item.

    ``doc`` is the id and ``tag`` is ``xxhash64`` of the text.
    """
    source = docs.select(_row(id_col, text_col).alias("doc"), text_of(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), text_of(item_text_col).alias("text"))
    items = items.withColumn("words", template(F.col("text"))).filter("size(words) > 0")
    items = items.withColumn("span", F.least(F.size("words"), F.lit(window)))
    spans = sorted(r.span for r in items.select("span").distinct().collect())  # at most ``window`` numbers
    if not spans:
        spans = [window]
    by_span = F.coalesce(*[F.when(F.col("span") == n, windows(F.col("words"), n)) for n in spans])
    wanted = items.select("item", "span", "words", F.posexplode(by_span).alias("item_at", "h"))
    marks = [NUMBER, NAME, UNIT]
    wanted = cut(wanted.filter(F.exists(F.slice("words", F.col("item_at") + 1, F.col("span")), lambda w: ~w.isin(marks))).drop("words"))
    totals = wanted.groupBy("item").agg(F.count("*").alias("total"), F.first("span").alias("span"))

    def shown(words: Column, n: int) -> Column:
        found = F.transform(windows(words, n), lambda h, i: F.struct(i.alias("at"), h.alias("h")))
        return F.when(F.size(words) == n, found).otherwise(F.slice(found, 1, 0)) if n < min(MIN_WORDS, window) else found

    made = source.select("doc", F.inline(let(template(F.col("text")), lambda words: F.concat(*[shown(words, n) for n in spans]))))
    few = wanted.limit(MAX_BROADCAST_WINDOWS + 1).count() <= MAX_BROADCAST_WINDOWS
    hits = cut(made.join(F.broadcast(wanted) if few else wanted, "h").select("doc", "item", "item_at", "at", "span").distinct())
    share = F.count_distinct("item_at") / F.first("total")
    candidates = cut(
        hits.drop("span").join(totals, "item").groupBy("doc", "item").agg(share.alias("share"), F.first("span").alias("span")).filter(F.col("share") >= min_share)
    )
    # slots under the matched windows
    texts = source.join(candidates.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
    doc_slots = texts.select("doc", F.inline(slots(F.col("text"))).alias("doc_at", "kind", "doc_value"))
    item_slots = items.join(candidates.select("item").distinct(), "item", "left_semi").select("item", F.inline(slots(F.col("text"))).alias("at_item", "kind", "item_value"))
    placed = _occurrences(hits.drop("span").join(candidates.select("doc", "item", "span"), ["doc", "item"]))
    by_place = ["doc", "item", "place"]
    shown = placed.join(totals.select("item", "total"), "item").groupBy(by_place).agg(share.alias("shown")).filter((F.col("shown") >= min_share) | (F.col("place.by") == "all"))
    faced = (
        placed.select(*by_place, "at", "item_at", F.explode(F.sequence(F.lit(0), F.col("span") - 1)).alias("k"))
        .select(*by_place, (F.col("at") + F.col("k")).alias("doc_at"), (F.col("item_at") + F.col("k")).alias("at_item"))
        .distinct()
    )
    values = faced.join(item_slots, ["item", "at_item"]).join(doc_slots, ["doc", "doc_at", "kind"])
    by_value = values.groupBy(*by_place, "kind", "item_value").agg(
        F.count_distinct("doc_value").alias("n"), F.max(F.col("doc_value") != F.col("item_value")).alias("changed")
    )
    checked = by_value.groupBy(by_place).agg(
        F.count("*").alias("n_slots"), F.count_if(F.col("n") > 1).alias("n_clashes"), F.count_if(F.col("changed")).alias("n_changed")
    )
    judged = shown.join(checked, by_place, "left").fillna(0, ["n_slots", "n_clashes", "n_changed"])
    judged = judged.filter((F.col("n_clashes") <= max_clashes * F.col("n_slots")) | (F.col("n_changed") == 0))
    # the occurrence of fewest clashes stands for the document; a change in any kept one counts
    best = F.min_by(F.struct("n_slots", "n_clashes"), F.struct(F.col("n_clashes") / F.greatest("n_slots", F.lit(1)), -F.col("shown"), -F.col("n_slots")))
    kept = judged.groupBy("doc", "item").agg(best.alias("best"), F.max("n_changed").alias("n_changed"))
    return candidates.select("doc", "item", "share").join(kept, ["doc", "item"]).select("doc.id", "doc.tag", "item", "share", "best.n_slots", "best.n_clashes", "n_changed").withColumnRenamed("id", "doc")


def _occurrences(hits: DataFrame) -> DataFrame:
    """``hits`` (doc, item, item_at, at, span) with ``place`` (by, no): each hit under its alignment,
    under its run and under all of its document."""
    pair = Window.partitionBy("doc", "item")
    by_at = hits.groupBy("doc", "item", "at").agg(F.max("item_at").alias("most"))
    back = F.coalesce((F.col("most") <= F.lag("most").over(pair.orderBy("at"))).cast("int"), F.lit(0))
    runs = by_at.withColumn("back", back).select("doc", "item", "at", F.sum("back").over(pair.orderBy("at")).alias("run"))
    place = lambda by, no: F.struct(F.lit(by).alias("by"), no.cast("long").alias("no"))
    places = F.array(place("alignment", F.col("at") - F.col("item_at")), place("run", F.col("run")), place("all", F.lit(0)))
    return hits.join(runs, ["doc", "item", "at"]).withColumn("place", F.explode(places))


def flag(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row per row of ``docs``: id, whether it shows items, how many, which (sorted, comma
    between) and whether any of their values was changed."""
    found = find(docs, benchmark, id_col, text_col, **more)
    by_doc = found.groupBy(F.struct(F.col("doc").alias("id"), "tag").alias("hit")).agg(
        F.count("*").alias("n_items"),
        F.array_join(F.array_sort(F.collect_list("item")).cast("array<string>"), ",").alias("items"),  # at most the benchmark
        (F.max("n_changed") > 0).alias("reparameterised"),
    )
    rows = docs.select(_row(id_col, text_col).alias("row"))
    return rows.join(by_doc, F.col("row") == F.col("hit"), "left").select(
        F.col("row.id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )
