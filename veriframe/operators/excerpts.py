"""Excerpts placed in bodies: spans of every match, each verified, the first method or part that finds any.

An excerpt is looked for part by part (as it stands, then after a printed label, with and without
its closing marks) and method by method (exact, tolerant, transliteration). Excerpts and bodies meet
by the rarest word or run of two or three of each part: an equi-join of their hashes, so that no side is
broadcast and no body is compared with an excerpt it shares none with. The words are those of the
strongest fold, since every match by a weaker one holds them too. What meets is placed and verified
in Arrow batches, row by row in the order of the bodies, so that a body is folded once; the decision which part and method count is a window over an excerpt's verified matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from veriframe.functions import offsets as O
from veriframe.session import stored


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


# types and not their names: importing needs no session
SPANS = ArrayType(_struct(start=IntegerType(), end=IntegerType()))
_AT_ONCE = 256  # texts folded with their maps before they are handed on
_WORDS = ArrayType(StringType())
_FOLDED = _struct(text=StringType(), starts=ArrayType(IntegerType()), ends=ArrayType(IntegerType()))
_PARTS = ArrayType(_struct(grp=IntegerType(), part=IntegerType(), ranges=SPANS, words=ArrayType(_WORDS)))
_FOUND = ArrayType(_struct(grp=IntegerType(), part=IntegerType(), method=IntegerType(), ranges=SPANS, spans=SPANS, ok=BooleanType()))


@F.pandas_udf(_WORDS)
def anchor_words(texts: pd.Series) -> pd.Series:
    """All words and runs of two or three of a body that some excerpt may be met by, once each."""

    def of(text: str | None) -> list[str]:
        first, *others = O.anchors(text)
        return first if all(words is first for words in others) else list({w for words in (first, *others) for w in words})

    return texts.map(of)


@F.pandas_udf(StringType())
def tolerant_text(texts: pd.Series) -> pd.Series:
    """The tolerant fold of each text without its offset map."""
    return texts.map(O.folded)


def _folds(batches: Iterator[pd.Series], level: str) -> Iterator[pd.DataFrame]:
    """Folds with their maps, a few texts at a time: a map is many times its text."""
    for texts in batches:
        for k in range(0, max(len(texts), 1), _AT_ONCE):
            yield pd.DataFrame([(t, np.array(a, "int32"), np.array(b, "int32")) for t, a, b in (O.fold(t, level) for t in texts[k : k + _AT_ONCE])], columns=["text", "starts", "ends"])


@F.pandas_udf(_FOLDED)
def tolerant(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The tolerant fold of each text with its offset map."""
    yield from _folds(batches, O.TOLERANT)


@F.pandas_udf(_FOLDED)
def transliterated(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The transliteration fold of each text with its offset map."""
    yield from _folds(batches, O.TRANSLITERATION)


@F.pandas_udf(_PARTS)
def parts(excerpts: pd.Series) -> pd.Series:
    """The parts of an excerpt: group, place in it, ranges between ellipses, and the lists of words and
    runs to meet by; a list that two methods share stands once."""
    pair = lambda ranges: [{"start": a, "end": b} for a, b in ranges]

    def of(text: str | None) -> list[dict]:
        out = []
        for g, group in enumerate(O.cores(text)):
            for p, core in enumerate(group):
                ranges = O.pieces(text, *core)
                by_piece = [O.anchors(text[a:b]) for a, b in ranges]
                words = sorted({tuple(sorted({w for lists in by_piece for w in lists[m]})) for m in range(len(O.METHODS))})
                out.append({"grp": g, "part": p, "ranges": pair(ranges), "words": words})
        return out

    return excerpts.map(of)


def candidates(excerpts: DataFrame, bodies: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(excerpt_id, id, parts): bodies that hold the rarest word or run of some parts of an excerpt.

    A part without a word (marks only) is met by no body. excerpts: excerpt_id, excerpt; bodies: id, body.
    ``before`` (excerpt_id, first): only parts of a group before ``first``.
    """
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))  # noqa: E731  # equal hashes of other words only meet in vain
    words = bodies.select("id", F.explode(hashed(anchor_words("body"))).alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    asked = excerpts.select("excerpt_id", F.explode(parts("excerpt")).alias("p")).select("excerpt_id", "p.grp", "p.part", "p.ranges", F.posexplode("p.words").alias("m", "words"))
    if before is not None:
        asked = asked.join(before, "excerpt_id").filter("grp < first")
    known = asked.select("excerpt_id", "grp", "part", "ranges", "m", F.explode(hashed("words")).alias("word")).join(df, "word", "left")
    rarest = known.groupBy("excerpt_id", "grp", "part", "m").agg(
        F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"), F.any_value("ranges").alias("ranges")
    ).drop("m").distinct()  # the methods mostly agree on the word
    met = rarest.join(words, "word").groupBy("excerpt_id", "id")
    return met.agg(F.array_sort(F.collect_set(F.struct("grp", "part", "ranges"))).alias("parts"))  # a few parts an excerpt


def placed(excerpts: DataFrame, bodies: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(excerpt_id, id, grp, part, method, ranges, spans, ok): every place of every part by the
    strictest method that is verified, and by those before it; ``ok`` is the verdict of the check that knows only the two texts.
    ``met``: the candidates, if they are known already."""
    met = candidates(excerpts, bodies) if met is None else met
    pairs = met.join(excerpts, "excerpt_id").join(bodies.hint("merge"), "id")  # sorted: what a body meets stands together

    @F.pandas_udf(_FOUND)
    def find(texts: pd.Series, held: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([_places(e, b, p) for e, b, p in zip(texts, held, wanted)])

    found = pairs.select("excerpt_id", "id", F.explode(find("excerpt", "body", "parts")).alias("f")).select("excerpt_id", "id", "f.*")
    return found.withColumn("method", F.element_at(F.array(*map(F.lit, O.METHODS)), F.col("method") + 1))


def _places(excerpt: str, body: str, wanted) -> list[dict]:
    out = []
    as_pairs = lambda ranges: [{"start": a, "end": b} for a, b in ranges]
    for p in wanted:
        ranges = [(r["start"], r["end"]) for r in p["ranges"]]
        for m, method in enumerate(O.METHODS):
            spans = O.place(excerpt, body, ranges, method)
            if spans:
                ok = O.verified(excerpt, body, ranges, spans, method)
                out.append({"grp": p["grp"], "part": p["part"], "method": m, "ranges": as_pairs(ranges), "spans": as_pairs(spans), "ok": ok})
                if ok:  # a weaker method would only find the same again
                    break
    return out


def _rank() -> list:
    return [F.col("part"), F.array_position(F.array(*map(F.lit, O.METHODS)), F.col("method"))]


def find(found: DataFrame, most: int = 25) -> DataFrame:
    """(excerpt_id, id, method, ranges, spans, no, total, dropped): the matches of the first part and
    method of an excerpt with any verified one, at most ``most`` shown by id, all counted, and how
    many of that part and method failed the check. ``found`` is the result of ``placed``."""
    found = stored(found)
    step = F.struct("grp", *[r.alias(f"r{k}") for k, r in enumerate(_rank())])
    stepped = found.withColumn("step", step)
    first = stepped.filter("ok").groupBy("excerpt_id").agg(F.min("step").alias("first"))
    decided = stepped.join(first, "excerpt_id").filter("step = first")
    counts = decided.groupBy("excerpt_id").agg(F.count_if("ok").alias("total"), F.count_if(~F.col("ok")).alias("dropped"))
    # the limit on the number goes into each task's part of a group, so a common excerpt is no hot one
    shown = decided.filter("ok").withColumn("no", F.row_number().over(Window.partitionBy("excerpt_id").orderBy("id"))).filter(F.col("no") <= most)
    return shown.join(counts, "excerpt_id").select("excerpt_id", "id", "method", "ranges", "spans", "no", "total", "dropped")


def find_every(found: DataFrame) -> DataFrame:
    """(excerpt_id, id, part, method, ranges, spans, total): every body of the first group of parts
    that has a verified match, each once by its fullest part and strictest method."""
    found = stored(found)
    first = found.filter("ok").groupBy("excerpt_id").agg(F.min("grp").alias("grp"))
    held = found.filter("ok").join(first, ["excerpt_id", "grp"])
    best = held.withColumn("k", F.row_number().over(Window.partitionBy("excerpt_id", "id").orderBy(*_rank()))).filter("k = 1")
    total = best.groupBy("excerpt_id").agg(F.count("*").alias("total"))
    return best.join(total, "excerpt_id").select("excerpt_id", "id", "part", "method", "ranges", "spans", "total")


def find_own(excerpts: DataFrame, bodies: DataFrame) -> DataFrame:
    """(excerpt_id, part, method, ranges, spans): what ``find_every`` gives an excerpt in the body of its
    own id. An excerpt meets only that body; other bodies are asked for its earlier groups of parts,
    which would come first if any held them."""
    wanted = F.filter(parts("excerpt"), lambda p: F.exists(p.words, lambda w: F.size(w) > 0))
    wanted = F.transform(wanted, lambda p: F.struct(p.grp.alias("grp"), p.part.alias("part"), p.ranges.alias("ranges")))
    own = excerpts.select("excerpt_id", F.col("excerpt_id").alias("id"), wanted.alias("parts"))
    own = stored(placed(excerpts, bodies.filter("body IS NOT NULL"), own).filter("ok"))
    first = own.groupBy("excerpt_id").agg(F.min("grp").alias("first"))
    earlier = placed(excerpts, bodies, candidates(excerpts, bodies, first)).filter("ok").select("excerpt_id").distinct()
    best = Window.partitionBy("excerpt_id").orderBy("grp", *_rank())
    own = own.withColumn("k", F.row_number().over(best)).filter("k = 1").join(earlier, "excerpt_id", "left_anti")
    return own.select("excerpt_id", "part", "method", "ranges", "spans")
