"""Calls and contacts as a reader is shown them, and quotes that must cite a record's own fields.

A shown line mixes fields of the record with words around them. A quote cites the record only where
it stands word-aligned and takes in a letter or digit of a field: the words around, and what stands
for a field that is missing, are nobody's evidence.

Aliases are sought in texts as words in a row: text and alias meet on the alias's rarest pair of words.
Texts are taken to be in composed form (NFC). Nulls: a null text holds nothing, a null quote or
alias is found nowhere. Offsets are code points from 0, the end outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import contains_aligned
from veriframe.operators.stated import offsets

# What stands for a field that is missing.
UNKNOWN, NO_NAME = "unknown", "(no name)"
_LETTER, _WORD_CHAR = r"[\p{L}\p{N}]", r"[\p{L}\p{N}_]"


# ------------------------------------------------------------------ shown lines
def _shown(parts: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """A line and the spans (a, b) of the record's own fields in it, from (piece, own) in order."""
    at, spans = F.lit(0), []
    for piece, own in parts:
        end = at + F.length(piece)
        spans.append(F.when(own & (F.length(piece) > 0), F.struct(at.alias("a"), end.alias("b"))))
        at = end
    return F.concat(*[piece for piece, _ in parts]), F.array_compact(F.array(*spans))


def _field(c: Column, missing: str) -> tuple[Column, Column]:
    return F.coalesce(c, F.lit(missing)), c.isNotNull()


def call_line(app: Column, direction: Column, sender: Column, receiver: Column, duration_s: Column) -> tuple[Column, Column]:
    """A call's shown text and the spans of its own fields; null fields are unknown, a null app is empty."""
    words = lambda t: (F.lit(t), F.lit(False))
    known = F.coalesce(direction, F.lit(UNKNOWN))
    return _shown([
        (known, known != UNKNOWN), words(" "), (F.coalesce(app, F.lit("")), F.lit(True)), words(" call from "), _field(sender, UNKNOWN), words(" to "), _field(receiver, UNKNOWN),
        words(", duration "), _field(duration_s.cast("string"), UNKNOWN), (F.when(duration_s.isNull(), "").otherwise(" s"), F.lit(False)),
    ])


def contact_line(name: Column, identifier: Column) -> tuple[Column, Column]:
    """A contact's shown text and the spans of its own fields; an empty name is none."""
    return _shown([_field(F.when(name != "", name), NO_NAME), (F.lit(": "), F.lit(False)), (F.coalesce(identifier, F.lit("")), F.lit(True))])


def cites(quote: Column, line: Column, own: Column) -> Column:
    """Whether the quote stands word-aligned in a shown line where it takes in a letter or digit of
    the record's own fields. Lines are short; a message is its own field whole (``cites_message``)."""
    n = F.length(quote)
    char = lambda text, i: F.substring(text, i + 1, F.lit(1))
    joins = lambda left, right: left.rlike(_WORD_CHAR) & right.rlike(_WORD_CHAR)

    def at(i: Column) -> Column:
        cut = ((i > 0) & joins(char(line, i - 1), F.left(quote, F.lit(1)))) | ((i + n < F.length(line)) & joins(F.right(quote, F.lit(1)), char(line, i + n)))
        takes = lambda x: F.substring(line, F.greatest(i, x.a) + 1, F.greatest(F.least(i + n, x.b) - F.greatest(i, x.a), F.lit(0))).rlike(_LETTER)
        return (F.substring(line, i + 1, n) == quote) & ~cut & F.exists(own, takes)

    held = line.contains(quote) & (n > 0)
    return F.coalesce(F.when(held, F.exists(F.sequence(F.lit(0), F.length(line) - n), at)), F.lit(False))


def cites_message(quote: Column, body: Column) -> Column:
    """The same for a message."""
    return F.coalesce(quote.rlike(_LETTER) & contains_aligned(body, quote), F.lit(False))


# ------------------------------------------------------------------ alias places
def _folded(c: Column) -> Column:
    """Lower case, with the one letter that folds to two, and one small sigma."""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_folded(text), F.lit(f"{_LETTER}+"), F.lit(0))


def without_the(name: Column) -> Column:
    return F.regexp_replace(name, r"(?iU)^\s*the\s+", "")


def in_capitals(name: Column) -> Column:
    """A name of two capitals or more, without a small letter or a digit, its "the" not counted."""
    core = without_the(name)
    return (F.length(F.regexp_replace(core, r"[^\p{Lu}]", "")) >= 2) & ~core.rlike(r"\p{Ll}|\p{N}")


def _runs(words: Column) -> Column:
    """Each word and, where another follows it, both: what texts and aliases meet by."""
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))
    return F.posexplode_outer(F.transform(pairs, lambda x: F.array(x.a, F.concat(x.a, F.lit(" "), x.b))))


def alias_places(aliases: DataFrame, texts: DataFrame) -> DataFrame:
    """(alias_id, text_id, start, end, lowered): where texts write an alias, word by word in any case
    and with any marks between, never inside a longer word or a handle; places of one alias do not
    overlap. ``lowered``: the alias is in capitals and these words are not: they may be the noun.

    aliases: alias_id (unique), alias; texts: text_id (unique), text. Work grows with the places of each
    alias's rarest pair of neighbouring words (of an alias of one word: that word).
    """
    named = aliases.select("alias_id", "alias", _words(F.col("alias")).alias("words")).filter(F.size("words") > 0)
    several = F.size("words") > 1
    asked = named.select("alias_id", several.alias("several"), _runs(F.col("words")).alias("k", "run")).select("alias_id", "k", F.when(F.col("several"), F.get("run", F.lit(1))).otherwise(F.get("run", F.lit(0))).alias("run")).filter("run IS NOT NULL")
    # a text is folded at once, its words held apart by the one character that is in none of them
    said = F.split(_folded(F.array_join(F.regexp_extract_all("text", F.lit(f"{_LETTER}+"), F.lit(0)), " ")), " ")
    flat = texts.select("text_id", said.alias("words")).select("text_id", _runs(F.col("words")).alias("i", "runs"))
    # outer: an inner explode would have its input computed once more; only runs that aliases have are counted and sent
    heard = flat.select("text_id", "i", F.explode_outer("runs").alias("run")).join(asked.select("run").distinct(), "run", "left_semi")
    df = heard.groupBy("run").agg(F.count("*").alias("df"))
    rarest = asked.join(df, "run", "left").groupBy("alias_id").agg(F.min_by(F.struct("k", "run"), F.struct(F.coalesce("df", F.lit(0)), "k")).alias("r")).select("alias_id", "r.*")
    first = rarest.join(heard, "run").select("alias_id", "text_id", (F.col("i") - F.col("k")).alias("i")).filter("i >= 0")
    # a text travels once, to all the places it may have
    asked_of = first.join(named, "alias_id").groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("i", "alias_id", "alias", "words"))).alias("places"))
    marked = F.split(F.regexp_replace(F.translate("text", "\u0001", "\u0002"), f"{_LETTER}+", "\u0001$0\u0001"), "\u0001")
    met = texts.select("text_id", "text").join(asked_of, "text_id").select("text_id", "places", marked.alias("parts"))
    # every other part is a word; what lies between two places is measured once
    met = met.withColumn("at", F.transform("places", lambda x: x.i * 2 + 1))
    before = lambda p, j: F.coalesce(F.get("at", j - 1), F.lit(0))
    between = F.transform("at", lambda p, j: F.length(F.array_join(F.slice("parts", before(p, j) + 1, p - before(p, j)), "")))
    met = met.withColumn("starts", offsets(F.concat(between, F.array(F.lit(0)))))
    placed = F.transform("places", lambda x, j: F.struct(x.alias_id.alias("alias_id"), x["alias"].alias("alias"), x.words.alias("words"), x.i.alias("i"), F.get("starts", j + 1).alias("start"), F.slice("parts", x.i * 2 + 1, F.size(x.words) * 2 + 1).alias("parts")))
    rows = met.select("text_id", F.explode_outer(placed).alias("p")).select("text_id", "p.*")
    n = F.size("words")
    rows = rows.withColumn("said", F.filter("parts", lambda p, j: j % 2 == 1)).filter(F.transform("said", _folded) == F.col("words"))
    left, right = F.right(F.get("parts", F.lit(0)), F.lit(1)), F.left(F.get("parts", n * 2), F.lit(1))
    rows = rows.filter(~left.isin("_", "@", "+") & (right != "_"))
    small = F.exists(F.filter("said", lambda x, j: ~((j == 0) & (_folded(x) == "the") & (n > 1))), lambda x: x.rlike(r"\p{Ll}"))
    end = F.col("start") + F.length(F.array_join(F.slice("parts", F.lit(2), n * 2 - 1), ""))
    rows = rows.select("alias_id", "text_id", n.alias("n"), F.struct("i", "start", end.alias("end"), (in_capitals(F.col("alias")) & small).alias("lowered")).alias("x"))
    grouped = rows.groupBy("alias_id", "text_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("x")).alias("xs"))  # the places of one alias in one text
    none = F.array().cast("array<struct<i:int,start:int,end:int,lowered:boolean>>")
    kept = F.aggregate("xs", none, lambda acc, x: F.when((F.size(acc) == 0) | (x.i >= F.get(acc, F.size(acc) - 1).i + F.col("n")), F.array_append(acc, x)).otherwise(acc))
    return grouped.select("alias_id", "text_id", F.inline(kept)).drop("i")
