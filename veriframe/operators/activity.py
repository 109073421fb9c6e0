"""What reviewers did, and how right the results were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AWAY_US = 30 * 60 * 1_000_000


def time_on_page(steps: DataFrame) -> DataFrame:
    """Views with the seconds to the next view of their session; over 30 minutes is away, the last
    view has none. steps: session, seq, us, kind ('view' or an action), page."""
    w = Window.partitionBy("session").orderBy("us", "seq")
    views = steps.filter("kind = 'view'").withColumn("next_us", F.lead("us").over(w))
    gap = F.col("next_us") - F.col("us")
    return views.select("session", "seq", "page", F.when(gap <= AWAY_US, F.floor(gap / 1_000_000)).alias("seconds"), F.coalesce(gap > AWAY_US, F.lit(False)).alias("away"))


def by_page(visits: DataFrame) -> DataFrame:
    return visits.groupBy("page").agg(
        F.count("*").alias("opens"), F.sum(F.coalesce("seconds", F.lit(0))).alias("seconds"), F.count_if(F.col("away")).alias("n_away"),
        F.count_if(F.col("seconds").isNull() & ~F.col("away")).alias("n_untimed"), F.count_distinct("session").alias("sessions"),
    )


def refreshes(steps: DataFrame, seconds: int = 60) -> DataFrame:
    """Views without those that show the page of the view before again within ``seconds``."""
    w = Window.partitionBy("session").orderBy("us", "seq")
    again = (F.lag("page").over(w) == F.col("page")) & (F.col("us") - F.lag("us").over(w) <= seconds * 1_000_000)
    return steps.filter("kind = 'view'").withColumn("_again", F.coalesce(again, F.lit(False))).filter("NOT _again").drop("_again")


def wilson(k: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """The 95 % interval of a share, clamped to [0, 1]; null for n = 0."""
    p, d = k / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    safe = lambda c: F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    return safe(centre - half), safe(centre + half)


def scored(gold: DataFrame, predictions: DataFrame, key: str, label: str) -> DataFrame:
    """Gold rows with their prediction; a missing one counts as 'missing', and so as wrong."""
    return gold.select(key, F.col(label).alias("gold")).join(predictions.select(key, F.col(label).alias("predicted")), key, "left").fillna("missing", ["predicted"])


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def rates(rows: DataFrame, by: str) -> DataFrame:
    """Share of right predictions for each value of ``by``, with its Wilson interval."""
    t = rows.groupBy(by).agg(F.count_if(F.col("gold") == F.col("predicted")).alias("k"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return t.select(by, "k", "n", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


def funnel(pairs: DataFrame, stages: list[str]) -> DataFrame:
    """The furthest stage of each pair, counted. ``pairs``: one boolean column for each stage."""
    reached = F.greatest(*[F.when(F.col(s), k + 1).otherwise(0) for k, s in enumerate(stages)])
    names = F.array(F.lit("not_reached"), *map(F.lit, stages))
    return pairs.select(F.element_at(names, (reached + 1).cast("int")).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


def run_profile(calls: DataFrame, job: str, max_gap_us: int = 600_000_000) -> DataFrame:
    """Working time of each job (gaps up to ``max_gap_us`` between its calls) and its outcomes."""
    w = Window.partitionBy(job).orderBy("us", "seq")
    gap = F.col("us") - F.lag("us").over(w)
    t = calls.withColumn("gap", F.when(gap <= max_gap_us, gap))
    return t.groupBy(job).agg(
        F.count("*").alias("n"), F.floor(F.coalesce(F.sum("gap"), F.lit(0)) / 1_000_000).alias("busy_s"), F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.count_if(F.col("outcome") != "ok").alias("n_other"),
    )


def error_log(summaries: DataFrame) -> DataFrame:
    """Sums over usable summaries by pilot; unusable ones are left out and counted."""
    use = F.col("complete")
    return summaries.groupBy("pilot").agg(
        F.count_if(use).alias("n_cases"), F.count_if(~use).alias("n_left_out"), F.sum(F.when(use, F.col("claims")).otherwise(0)).alias("claims"), F.sum(F.when(use, F.col("flags")).otherwise(0)).alias("flags"),
    ).withColumn("rate", F.when(F.col("claims") > 0, F.round(F.col("flags") / F.col("claims"), 9)))
