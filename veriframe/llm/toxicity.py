"""Toxicity (9): gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text, all of them expressions of the row: densities of a given and of two learnt
lexicons (words and word beginnings, which carry over to inflected and compounded forms), how
often a lexicon word stands near a second person, capitals, emphasis marks, words that hide
letters behind digits or signs (which are also read in clear), word length and text length.

Learning reads labelled rows of which ``crc32(id as text) mod 5`` is not 0, at most
``MAX_ROWS`` of them, those of the smallest hash of their id: a bounded, repeatable sample.
It is split by hash in three: lexicons, trees, calibration, so that none is fitted to rows the
one before has seen. Scoring is a projection over every row of every document.

Null and empty texts have features of zero and get the score these give. A null id counts as
the empty text for the remainder and is never learnt from; of rows with one id each gets its
own score. If the sample holds fewer than two classes the score is the share of label 1 in it,
0 without labels. Labels, languages and sources are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut, text_of

MAX_ROWS, MAX_TERMS, MIN_DOCS, MIN_LOG_ODDS = 16_000, 1_500, 4, 1.5
PREFIXES = (5, 6, 7)
TREES, DEPTH = 30, 4

# Insults of the given lexicon, and second-person words of four languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown fool jerk freak "
    "garbage ugly hate kill die shut imbecile crap damn hell vermin filth creep lunatic liar coward "
    "dumm idiotin trottel abschaum müll ekelhaft wertlos verlierer imbécile crétin ordure minable dégoûtant nul raté "
    "estúpido idiota imbécil basura asqueroso patético inútil payaso perdedor escoria"
).split()
SECOND = "you your yours yourself u ur ya du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes vosotros".split()
FEATURES = (
    "insult_density", "word_density", "prefix_density", "word_hits", "prefix_hits", "near_second", "second_density", "capital_rate",
    "emphasis_rate", "hidden_rate", "mean_length", "log_words",
)


def tokens(text: Column) -> Column:
    """Lower-case words without outer signs; inner signs stay (for hidden letters)."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+(?=\s|$)", "")
    return F.array_remove(F.split(bare, r"[^\p{L}\p{N}@$*]+"), "")


def in_clear(words: Column) -> Column:
    """The words that hide letters, read in clear."""
    hidden = F.filter(words, lambda w: w.rlike(r"^\p{L}+[0-9@$*]+\p{L}") & ~w.rlike(r"[0-9]{3}"))
    return F.transform(hidden, lambda w: F.regexp_replace(F.translate(w, "013457@$", "oieastas"), r"\*", ""))


@dataclass
class Model:
    words: list[str]
    prefixes: list[str]
    trees: GBTClassificationModel | None = None
    bounds: list[float] | None = None
    levels: list[float] | None = None
    rate: float = 0.0


def features(docs: DataFrame, words: list[str], prefixes: list[str], text_col: str = "text", out: str = "_tox") -> DataFrame:
    """``docs`` with a struct ``out`` of ``FEATURES``."""
    text = text_of(text_col)
    found = docs.withColumn(out, F.struct(tokens(text).alias("t")))
    found = found.withColumn(out, F.struct(F.col(out).t.alias("t"), in_clear(F.col(out).t).alias("c")))
    found = found.withColumn(out, F.struct(F.concat(F.col(out).t, F.col(out).c).alias("t"), F.size(F.col(out).c).alias("hidden")))
    t = F.col(out).t
    member = lambda w, names: w.isin(names) if names else F.lit(False)
    count = lambda names: F.size(F.filter(t, lambda w: member(w, names)))
    begins = lambda w: sum([F.when(member(F.left(w, F.lit(k)), by[k]) & (F.length(w) > k), 1).otherwise(0) for k in PREFIXES], F.lit(0))
    by = {k: [p for p in prefixes if len(p) == k] for k in PREFIXES}
    lexicon = sorted(set(INSULTS) | set(words))
    at = F.filter(F.transform(t, lambda w, i: F.when(member(w, lexicon), i).otherwise(-1)), lambda i: i >= 0)
    near = F.size(F.filter(at, lambda i: F.exists(F.slice(t, F.greatest(i - 3, F.lit(1)), F.lit(9)), lambda w: w.isin(SECOND))))
    starts = F.aggregate(F.transform(t, begins), F.lit(0), lambda a, x: a + F.least(x, F.lit(1)))
    counted = found.withColumn(out, F.struct(
        F.size(t).alias("n"), count(INSULTS).alias("insults"), count(words).alias("words"), starts.alias("starts"), near.alias("near"),
        count(SECOND).alias("second"), F.regexp_count(text, F.lit(r"\p{Lu}")).alias("capitals"), F.regexp_count(text, F.lit("[!?]")).alias("emphasis"),
        F.col(out).hidden.alias("hidden"), F.length(F.array_join(t, "")).alias("letters"),
    ))
    m = F.col(out)
    per_word = lambda c: F.when(m.n > 0, c / m.n).otherwise(0.0)
    values = (
        per_word(m.insults), per_word(m.words), per_word(m.starts), m.words.cast("double"), m.starts.cast("double"), per_word(m.near), per_word(m.second),
        F.when(m.letters > 0, m.capitals / m.letters).otherwise(0.0), per_word(m.emphasis), per_word(m.hidden), per_word(m.letters), F.log1p(m.n.cast("double")),
    )
    return counted.withColumn(out, F.struct(*[v.alias(n) for n, v in zip(FEATURES, values)]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(id, text, label, part) of the rows that are learnt from."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).filter(
        "id IS NOT NULL AND label IS NOT NULL"
    ).filter(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(ids), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))  # one text of an id, or the sample had no bound
    spot = F.pmod(F.xxhash64("id", F.lit("split")), F.lit(10))
    return rows.withColumn("part", F.when(spot < 4, "lexicon").when(spot < 8, "trees").otherwise("calibration"))


def _lexicon(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Words and word beginnings that mark label 1, by log odds over documents."""
    t = tokens(F.col("text"))
    terms = F.array_distinct(F.concat(F.transform(F.concat(t, in_clear(t)), lambda w: F.concat(F.lit("0"), w)), *[_begun(t, k) for k in PREFIXES]))
    total = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    yes, no = float(total[0] or 0), float(total[1] or 0)
    counted = rows.select("label", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("label").alias("y"), F.sum(1 - F.col("label")).alias("n"))
    odds = F.log((F.col("y") + 0.5) / (yes + 1)) - F.log((F.col("n") + 0.5) / (no + 1))
    marked = counted.filter(F.col("y") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS)
    top = marked.orderBy((F.col("odds") * F.sqrt("y")).desc(), "term").limit(MAX_TERMS).collect()  # MAX_TERMS rows at most
    return [r.term[1:] for r in top if r.term[0] == "0"], [r.term[1:] for r in top if r.term[0] != "0"]


def _begun(words: Column, k: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.lit(str(k)), F.left(w, F.lit(k))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    rows = cut(_sample(docs, labels, id_col, text_col, label_col, max_rows).repartition(8))  # a bounded sample
    words, prefixes = _lexicon(rows.filter("part = 'lexicon'"))
    seen = {(r.part, r.label): r.n for r in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    n = sum(seen.values())
    model = Model(words, prefixes, rate=sum(v for (_, y), v in seen.items() if y > 0.5) / n if n else 0.0)
    if not all((part, y) in seen for part in ("trees", "calibration") for y in (0.0, 1.0)):
        return model
    table = features(rows.filter("part <> 'lexicon'"), words, prefixes, out="_tox").select("label", "part", "_tox.*")
    table = cut(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(table).select("label", "part", "x").repartition(4))
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=64, seed=7, minInstancesPerNode=5)
    model.trees = trees.fit(table.filter("part = 'trees'"))
    raw = model.trees.transform(table.filter("part = 'calibration'")).select("label", vector_to_array("probability")[1].alias("p"))
    steps = IsotonicRegression(featuresCol="p", labelCol="label").fit(raw)
    model.bounds, model.levels = list(map(float, steps.boundaries.toArray())), list(map(float, steps.predictions.toArray()))
    return model


def _calibrated(p: Column, model: Model) -> Column:
    """The isotonic function, linear between its bounds, and a five-hundredth of ``p`` itself, so
    that its plateaus keep the order of ``p``."""
    bounds, levels = model.bounds, model.levels
    out = F.lit(levels[-1])
    for k in range(len(bounds) - 1, 0, -1):
        a, b, u, v = bounds[k - 1], bounds[k], levels[k - 1], levels[k]
        value = F.lit(u) if b <= a or u == v else F.lit(u) + (p - a) * ((v - u) / (b - a))
        out = F.when(p < b, value).otherwise(out)
    out = F.when(p <= bounds[0], F.lit(levels[0])).otherwise(out)
    return 0.998 * out + 0.002 * p


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, 0 to 1, higher where label 1 is likelier."""
    if model.trees is None:
        return docs.withColumn(out, F.lit(float(model.rate)))
    found = features(docs, model.words, model.prefixes, text_col, "__tox")
    parts = [F.col("__tox")[n].alias(n) for n in FEATURES]
    keep = found.columns[:-1]
    packed = found.select(F.struct(*keep).alias("__row"), *parts)
    packed = VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(packed).drop(*FEATURES)
    trees = model.trees.copy().setFeaturesCol("__x").setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__y")
    scored = trees.transform(packed).withColumn("__p", vector_to_array("__p")[1])
    return scored.select("__row.*", _calibrated(F.col("__p"), model).alias(out))
