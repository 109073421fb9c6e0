"""Verdict rules over assumptions, evidence and checks, and the state of reviews.

The rules run as two aggregations (by assumption, then by claim) and one ordered CASE each;
nothing is collected, and a claim without assumptions keeps its row.

Inputs: claims (claim_id, claim_type); assumptions (assumption_id, claim_id, kind, is_core,
count_op, owner_unconfirmed, agent_proposed); evidence (evidence_id, assumption_id, stance, status, tier);
checks (check_id, assumption_id, outcome, n_records, confirmed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.operators.timeline import natural_key
from veriframe.session import shared_path

# The assumption kind each claim type must test, and the types that code checks alone may carry.
REQUIRED_KIND = {
    "communication": "identity", "content_meaning": "meaning", "identity": "identity", "absence": "completeness", "count": "completeness", "timing": "time",
}
CODE_MAY_SUPPORT = ("communication", "timing", "count")
CITABLE = ("observed", "derived")


def latest(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def by_assumption(assumptions: DataFrame, evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """What the rules find for each assumption, with the tier that covers it (null: uncovered)."""
    alive = F.col("status") != "dismissed"
    accepted = F.col("status").isin("accepted", "counsel_accepted")
    says = lambda s: alive & (F.col("stance") == s)
    citable = says("supports") & F.col("tier").isin(*CITABLE)
    ev = evidence.groupBy("assumption_id").agg(
        F.count_if(says("contradicts") & accepted).alias("n_against"), F.count_if(says("contradicts") & ~accepted).alias("n_unconfirmed"),
        F.count_if(says("complicates")).alias("n_complicating"),
        F.count_if(says("supports") & accepted & (F.col("tier") == "observed")).alias("n_supports"),
        F.count_if(says("supports") & (F.col("status") == "accepted") & (F.col("tier") == "observed")).alias("n_expert_supports"),
        F.count_if(citable & (F.col("status") == "accepted")).alias("n_expert"), F.count_if(citable & (F.col("status") == "counsel_accepted")).alias("n_counsel"),
    )
    # a failed check of an assumption that an agent proposed counts once an expert confirmed it
    checks = checks.join(assumptions.select("assumption_id", "agent_proposed"), "assumption_id", "left")
    waits = F.coalesce(F.col("agent_proposed") & ~F.col("confirmed"), F.lit(False))
    ck = checks.groupBy("assumption_id").agg(
        F.count("*").alias("n_checks"), F.count_if((F.col("outcome") == "fail") & ~waits).alias("n_failed"), F.count_if((F.col("outcome") == "fail") & waits).alias("n_awaiting"), F.count_if(F.col("outcome") == "pass").alias("n_passed"),
        F.count_if((F.col("outcome") == "pass") & (F.col("n_records") > 0)).alias("n_passed_with_records"),
    )
    found = assumptions.join(ev, "assumption_id", "left").join(ck, "assumption_id", "left").fillna(0)
    tier = (
        F.when(F.col("owner_unconfirmed"), None)
        .when((F.col("n_checks") > 0) & (F.col("n_passed") == F.col("n_checks")), "derived")
        .when(F.col("n_expert") > 0, "confirmed")
        .when(F.col("n_counsel") > 0, "counsel_reviewed")
    )
    return found.withColumn("covered", F.when(F.col("is_core"), tier))


def verdicts(claims: DataFrame, assumptions: DataFrame, evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """(claim_id, verdict, basis, reasons): contradicted by a failed core check or an accepted
    contradiction; supported if nothing blocks it; else unproven."""
    f = by_assumption(assumptions, evidence, checks)
    core = F.col("is_core")
    need = F.create_map(*[F.lit(x) for pair in REQUIRED_KIND.items() for x in pair])
    f = f.join(claims, "claim_id").withColumn("right_kind", F.coalesce(F.col("kind") == F.element_at(need, F.col("claim_type")), F.lit(False)))
    n = lambda c: F.sum(F.when(core, F.col(c)).otherwise(0)).cast("long")
    agg = f.groupBy("claim_id").agg(
        F.count_if(core).alias("n_core"), n("n_failed").alias("failed"), n("n_against").alias("against"), n("n_unconfirmed").alias("open"), n("n_awaiting").alias("awaiting"),
        F.sum(F.when(~core, F.col("n_failed") + F.col("n_awaiting") + F.col("n_against") + F.col("n_unconfirmed")).otherwise(0)).cast("long").alias("other"),
        F.sum("n_complicating").cast("long").alias("complicating"), n("n_supports").alias("supports"), n("n_expert_supports").alias("expert"),
        F.count_if(core & F.col("covered").isNull()).alias("uncovered"), F.count_if(core & (F.col("covered") == "derived")).alias("derived"),
        F.count_if(core & (F.col("covered") == "counsel_reviewed")).alias("counsel_covered"), n("n_passed_with_records").alias("with_records"),
        F.count_if(core & F.col("right_kind")).alias("right_kind"), F.count_if(core & (F.col("count_op") == "eq")).alias("exact"),
    )
    c = claims.join(agg, "claim_id", "left").fillna(0)
    col = F.col
    by_code = col("claim_type").isin(*CODE_MAY_SUPPORT) & (col("n_core") > 0) & (col("derived") == col("n_core")) & (col("with_records") > 0) & (col("exact") == 0)
    kind_missing = (col("n_core") > 0) & F.element_at(need, col("claim_type")).isNotNull() & (col("right_kind") == 0)
    against = (col("failed") > 0) | (col("against") > 0)
    blockers = F.array_compact(F.array(
        F.when(col("n_core") == 0, "3a"), F.when(col("uncovered") > 0, "2"), F.when(kind_missing, "3e"),
        F.when((col("n_core") > 0) & (col("supports") == 0) & ~by_code, "3c"), F.when(col("other") > 0, "3d"), F.when(col("awaiting") > 0, "1a'"), F.when(col("open") > 0, "1b"), F.when(col("complicating") > 0, "3d'"),
    ))
    reasons = F.when(against, F.array_compact(F.array(F.when(col("failed") > 0, "1a"), F.when(col("against") > 0, "1b")))).otherwise(blockers)
    c = c.withColumn("reasons", F.array_join(reasons, ",")).withColumn("by_code", by_code)
    verdict = F.when(against, "contradicted").when(col("reasons") == "", "supported").otherwise("unproven")
    basis = F.when((col("expert") > 0) & (col("counsel_covered") == 0), "confirmed").when(col("by_code"), "checked").otherwise("counsel_reviewed")
    return c.withColumn("verdict", verdict).select("claim_id", "verdict", F.when(col("verdict") == "supported", basis).alias("basis"), "reasons")


def violations(decided: DataFrame, assumptions: DataFrame, evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """(claim_id, rule): decisions that break an invariant, from the inputs and not from the rules:
    a failed core check must contradict; a supported claim needs every core assumption untouched."""
    core = assumptions.filter("is_core")
    failed = core.join(checks.filter("outcome = 'fail'"), "assumption_id").select("claim_id").distinct()
    hit = core.join(evidence.filter("stance = 'contradicts' AND status <> 'dismissed'"), "assumption_id").select("claim_id").distinct()
    a = decided.join(failed, "claim_id").filter("verdict <> 'contradicted'").select("claim_id", F.lit("failed_check_ignored").alias("rule"))
    b = decided.filter("verdict = 'supported'").join(hit, "claim_id").select("claim_id", F.lit("supported_despite_contradiction").alias("rule"))
    c = decided.filter("verdict = 'supported'").join(core.select("claim_id").distinct(), "claim_id", "left_anti").select("claim_id", F.lit("supported_without_core").alias("rule"))
    d = decided.filter("(verdict = 'supported') <> (basis IS NOT NULL)").select("claim_id", F.lit("basis_mismatch").alias("rule"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def priority() -> Column:
    """The most urgent need of a claim's state, 0 to 8; 9 if nothing is left to do.

    State columns: incomplete, audited, edited, untested, n_withheld, contradiction, n_ai_accepted,
    n_open_support, n_open_against, decided_after, n_ai_dismissed, reviewed, verdict. Support of a
    claim that is supported already is optional, so it comes late.
    """
    c = F.col
    done = c("verdict") == "supported"
    needs = [
        (c("edited"), F.lit(0)), (c("untested"), F.lit(1)), (c("n_withheld") > 0, F.lit(1)), (c("contradiction"), F.lit(1)),
        (c("n_ai_accepted") > 0, F.when(done, 5).otherwise(1)), (c("n_open_support") > 0, F.when(done, 5).otherwise(2)), (c("n_open_against") > 0, F.lit(3)),
        (c("decided_after"), F.lit(4)), (c("n_ai_dismissed") > 0, F.lit(5)), (~c("reviewed"), F.lit(6)),
    ]
    return F.when(c("incomplete") | ~c("audited"), 8).otherwise(F.least(*[F.when(when, at) for when, at in needs], F.lit(9)))


def claim_states(decided: DataFrame, assumptions: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """One state for each claim: its verdict, what of its evidence waits for an expert, and its
    ``facts`` (claim_id, edited, decided_after, incomplete, reviewed; the columns of ``priority``)."""
    of_claim = evidence.join(assumptions.select("assumption_id", "claim_id"), "assumption_id")
    waits = lambda stance, *status: F.count_if((F.col("stance") == stance) & F.col("status").isin(*status))
    counted = of_claim.groupBy("claim_id").agg(
        waits("supports", "open").alias("n_open_support"), waits("complicates", "open").alias("n_open_complicates"), waits("contradicts", "open").alias("n_open_contradicts"),
        waits("supports", "ai_accepted").alias("n_ai_accepted"), waits("supports", "ai_dismissed").alias("n_ai_dismissed"),
        waits("contradicts", "ai_accepted").alias("n_contradictions"), F.count_if(F.col("status") == "withheld").alias("n_withheld"),
    )
    tested = assumptions.groupBy("claim_id").agg(F.count("*").alias("n_assumptions"))
    numbers = ["n_open_support", "n_open_complicates", "n_open_contradicts", "n_ai_accepted", "n_ai_dismissed", "n_contradictions", "n_withheld", "n_assumptions"]
    all_ = facts.join(decided.select("claim_id", "verdict"), "claim_id", "left").join(counted, "claim_id", "left").join(tested, "claim_id", "left").fillna(0, numbers)
    all_ = all_.withColumns({"audited": F.col("verdict").isNotNull(), "untested": F.col("n_assumptions") == 0, "contradiction": F.col("n_contradictions") > 0})
    # where a contradiction was found, the open ones are part of that need
    against = F.col("n_open_complicates") + F.when(F.col("contradiction"), 0).otherwise(F.col("n_open_contradicts"))
    all_ = all_.withColumn("n_open_against", against).drop("n_open_complicates", "n_open_contradicts")
    return all_.withColumn("priority", priority())


def review_queue(states: DataFrame) -> DataFrame:
    """(claim_id, priority, place): by priority, then in the natural order of the claims' ids.

    Places are counted by ranges of the order: each range is one task's, and the number of claims
    in the ranges before is added."""
    return numbered(states.select("claim_id", "priority"), ["priority", natural_key(F.col("claim_id").cast("string"))], "place")


def numbered(rows: DataFrame, order: list, out: str) -> DataFrame:
    """``rows`` with their place in a total order, from 1, without holding them in one task."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    named = rows.withColumns({f"__o{k}": key for k, key in enumerate(keys)})
    names = [f"__o{k}" for k in range(len(keys))]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.repartitionByRange(ranges, *names).sortWithinPartitions(*names).withColumn("__id", F.monotonically_increasing_id())
    path = shared_path(rows.sparkSession)
    dealt.write.parquet(path)  # the numbers hold for this dealing only
    dealt = rows.sparkSession.read.parquet(path).withColumn("__range", F.shiftright("__id", 33)).withColumn("__no", F.col("__id").bitwiseAND((1 << 33) - 1))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # as many rows as ranges
    base = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__base", base).drop("__n")
    return dealt.join(F.broadcast(sizes), "__range").withColumn(out, F.col("__base") + F.col("__no") + 1).select(*rows.columns, out)
