"""Verdicts, invariants, reviews and name levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators import rules as R
from veriframe.session import table

TYPES = ("communication", "count", "timing", "absence", "content_meaning", "role")
KINDS = ("identity", "completeness", "time", "meaning")


def _pick(names, c):
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(c, F.lit(len(names))) + 1).cast("int"))


def inputs(spark, sf_dir):
    """Claims, assumptions, evidence and checks laid over orders and lines."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    claims = o.filter(k % 3 == 0).select(k.alias("claim_id"), _pick(TYPES, F.floor(k / 3)).alias("claim_type"))
    assumptions = o.select(
        k.alias("assumption_id"), (k - k % 3).alias("claim_id"), _pick(KINDS, F.floor(k / 3) + k % 3 * (k % 2)).alias("kind"), (k % 3 != 2).alias("is_core"),
        F.when(k % 5 == 0, "eq").otherwise("ge").alias("count_op"), (k % 37 == 0).alias("owner_unconfirmed"), (k % 6 == 1).alias("agent_proposed"),
    )
    li = table(spark, sf_dir, "lineitem")
    n, key = F.col("l_linenumber"), F.col("l_orderkey")
    s = F.col("l_suppkey")
    evidence = li.filter(n % 3 != 0).select(
        (key * 10 + n).alias("evidence_id"), key.alias("assumption_id"), F.when(s % 23 == 0, "contradicts").when(s % 19 == 0, "complicates").otherwise("supports").alias("stance"),
        _pick(("accepted", "open", "counsel_accepted", "dismissed", "accepted"), F.col("l_partkey")).alias("status"), _pick(("observed", "derived", "observed"), F.col("l_partkey") + n).alias("tier"),
    )
    checks = li.filter(n % 3 == 0).select(
        (key * 10 + n).alias("check_id"), key.alias("assumption_id"), F.when(s % 29 == 0, "fail").when(s % 7 == 0, "inconclusive").otherwise("pass").alias("outcome"), (F.col("l_partkey") % 3).alias("n_records"), (F.col("l_partkey") % 2 == 0).alias("confirmed"),
    )
    return claims, assumptions, evidence, checks


def q_verdict_rules(spark, sf_dir):
    return R.verdicts(*inputs(spark, sf_dir))


def q_invariant_violations(spark, sf_dir):
    claims, assumptions, evidence, checks = inputs(spark, sf_dir)
    decided = R.verdicts(claims, assumptions, evidence, checks)
    planted = decided.withColumn("verdict", F.when(F.col("claim_id") % 50 == 0, "supported").otherwise(F.col("verdict")))  # decisions that break the rules
    return R.violations(planted, assumptions, evidence, checks)


def _states(spark, sf_dir):
    claims, assumptions, evidence, checks = inputs(spark, sf_dir)
    c = F.col("claim_id")
    status = F.when(F.col("evidence_id") % 31 == 0, "ai_accepted").when(F.col("evidence_id") % 37 == 0, "ai_dismissed").when(F.col("evidence_id") % 101 == 0, "withheld").otherwise(F.col("status"))
    decided = R.verdicts(claims, assumptions, evidence, checks).filter(c % 53 != 0)
    facts = claims.select("claim_id", (c % 41 == 0).alias("edited"), (c % 29 == 0).alias("decided_after"), (c % 47 == 0).alias("incomplete"), (c % 2 == 0).alias("reviewed"))
    return R.claim_states(decided, assumptions.filter("assumption_id % 59 <> 0"), evidence.withColumn("status", status), facts)


def q_claim_states(spark, sf_dir):
    return _states(spark, sf_dir).select("claim_id", "verdict", "n_open_support", "n_open_against", "n_ai_accepted", "n_withheld", "contradiction", "untested", "priority")


def q_review_queue(spark, sf_dir):
    return R.review_queue(_states(spark, sf_dir))


def q_latest_review(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    reviews = li.select(F.col("l_orderkey").alias("item"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.col("l_returnflag").alias("status"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"))
    found = items.join(R.latest(reviews, "item", "status", "seq"), "item", "left")
    return found.select("item", F.coalesce("status", F.lit("open")).alias("status"))


def q_status_counts(spark, sf_dir):
    claims = inputs(spark, sf_dir)[0]
    return R.verdicts(*inputs(spark, sf_dir)).join(claims, "claim_id").groupBy("claim_type").pivot("verdict", ["supported", "contradicted", "unproven"]).count().fillna(0)


QUERIES = {f.__name__: f for f in (q_verdict_rules, q_invariant_violations, q_claim_states, q_review_queue, q_latest_review, q_status_counts)}


def _case(names, expr):
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE ({expr}) % {len(names)} {whens} END"


_INPUTS = f"""
c AS (SELECT o_orderkey AS claim_id, {_case(TYPES, 'o_orderkey // 3')} AS claim_type FROM orders WHERE o_orderkey % 3 = 0),
need AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in R.REQUIRED_KIND.items())}) AS v(claim_type, need)),
a AS (SELECT o_orderkey AS aid, o_orderkey - o_orderkey % 3 AS claim_id, {_case(KINDS, 'o_orderkey // 3 + o_orderkey % 3 * (o_orderkey % 2)')} AS kind, o_orderkey % 3 <> 2 AS core,
  o_orderkey % 5 = 0 AS eq, o_orderkey % 37 = 0 AS unowned, o_orderkey % 6 = 1 AS agent FROM orders),
e AS (SELECT l_orderkey AS aid, CASE WHEN l_suppkey % 23 = 0 THEN 'contradicts' WHEN l_suppkey % 19 = 0 THEN 'complicates' ELSE 'supports' END AS stance,
  {_case(('accepted', 'open', 'counsel_accepted', 'dismissed', 'accepted'), 'l_partkey')} AS status, {_case(('observed', 'derived', 'observed'), 'l_partkey + l_linenumber')} AS tier FROM lineitem WHERE l_linenumber % 3 <> 0),
k AS (SELECT l_orderkey AS aid, CASE WHEN l_suppkey % 29 = 0 THEN 'fail' WHEN l_suppkey % 7 = 0 THEN 'inconclusive' ELSE 'pass' END AS outcome, l_partkey % 3 AS nr, l_orderkey % 6 = 1 AND l_partkey % 2 <> 0 AS waits FROM lineitem WHERE l_linenumber % 3 = 0),
ea AS (SELECT aid, count(*) FILTER (stance = 'contradicts' AND status IN ('accepted', 'counsel_accepted')) AS against, count(*) FILTER (stance = 'contradicts' AND status = 'open') AS opn,
  count(*) FILTER (stance = 'complicates' AND status <> 'dismissed') AS compl, count(*) FILTER (stance = 'supports' AND status IN ('accepted', 'counsel_accepted') AND tier = 'observed') AS sup,
  count(*) FILTER (stance = 'supports' AND status = 'accepted' AND tier = 'observed') AS exps, count(*) FILTER (stance = 'supports' AND status = 'accepted') AS expert,
  count(*) FILTER (stance = 'supports' AND status = 'counsel_accepted') AS counsel FROM e GROUP BY aid),
ka AS (SELECT aid, count(*) AS nk, count(*) FILTER (outcome = 'fail' AND NOT waits) AS nf, count(*) FILTER (outcome = 'fail' AND waits) AS nw, count(*) FILTER (outcome = 'pass') AS np, count(*) FILTER (outcome = 'pass' AND nr > 0) AS npr FROM k GROUP BY aid),
f AS (SELECT a.*, coalesce(against, 0) AS against, coalesce(opn, 0) AS opn, coalesce(compl, 0) AS compl, coalesce(sup, 0) AS sup, coalesce(exps, 0) AS exps, coalesce(nf, 0) AS nf, coalesce(nw, 0) AS nw, coalesce(npr, 0) AS npr,
  CASE WHEN unowned THEN NULL WHEN nk > 0 AND np = nk THEN 'derived' WHEN expert > 0 THEN 'confirmed' WHEN counsel > 0 THEN 'counsel_reviewed' END AS cov
  FROM a LEFT JOIN ea USING (aid) LEFT JOIN ka USING (aid)),
g AS (SELECT c.claim_id, c.claim_type, any_value(need) AS need, count(*) FILTER (core) AS n_core, coalesce(sum(nf) FILTER (core), 0) AS failed, coalesce(sum(against) FILTER (core), 0) AS against,
  coalesce(sum(opn) FILTER (core), 0) AS opn, coalesce(sum(nf + nw + against + opn) FILTER (NOT core), 0) AS other, coalesce(sum(nw) FILTER (core), 0) AS aw, coalesce(sum(compl), 0) AS compl, coalesce(sum(sup) FILTER (core), 0) AS sup,
  coalesce(sum(exps) FILTER (core), 0) AS exps, count(*) FILTER (core AND cov IS NULL) AS uncov, count(*) FILTER (core AND cov = 'derived') AS der, count(*) FILTER (core AND cov = 'counsel_reviewed') AS cc,
  coalesce(sum(npr) FILTER (core), 0) AS npr, count(*) FILTER (core AND kind = need) AS rk, count(*) FILTER (core AND eq) AS ex
  FROM c LEFT JOIN f ON f.claim_id = c.claim_id LEFT JOIN need ON need.claim_type = c.claim_type GROUP BY c.claim_id, c.claim_type),
h AS (SELECT *, claim_type IN ('communication', 'timing', 'count') AND n_core > 0 AND der = n_core AND npr > 0 AND ex = 0 AS by_code FROM g),
r AS (SELECT *, CASE WHEN failed + against > 0 THEN concat_ws(',', CASE WHEN failed > 0 THEN '1a' END, CASE WHEN against > 0 THEN '1b' END)
  ELSE concat_ws(',', CASE WHEN n_core = 0 THEN '3a' END, CASE WHEN uncov > 0 THEN '2' END, CASE WHEN n_core > 0 AND need IS NOT NULL AND rk = 0 THEN '3e' END,
    CASE WHEN n_core > 0 AND sup = 0 AND NOT by_code THEN '3c' END, CASE WHEN other > 0 THEN '3d' END, CASE WHEN aw > 0 THEN '1a''' END, CASE WHEN opn > 0 THEN '1b' END, CASE WHEN compl > 0 THEN '3d''' END) END AS reasons FROM h),
v AS (SELECT *, CASE WHEN failed + against > 0 THEN 'contradicted' WHEN reasons = '' THEN 'supported' ELSE 'unproven' END AS verdict FROM r),
d AS (SELECT *, CASE WHEN verdict = 'supported' THEN CASE WHEN exps > 0 AND cc = 0 THEN 'confirmed' WHEN by_code THEN 'checked' ELSE 'counsel_reviewed' END END AS basis FROM v)
"""
_STATES = """
le AS (SELECT l_orderkey * 10 + l_linenumber AS eid, l_orderkey AS aid, CASE WHEN l_suppkey % 23 = 0 THEN 'contradicts' WHEN l_suppkey % 19 = 0 THEN 'complicates' ELSE 'supports' END AS stance,
  CASE l_partkey % 5 WHEN 1 THEN 'open' ELSE 'other' END AS st FROM lineitem WHERE l_linenumber % 3 <> 0),
lx AS (SELECT aid - aid % 3 AS claim_id, stance, CASE WHEN eid % 31 = 0 THEN 'ai_accepted' WHEN eid % 37 = 0 THEN 'ai_dismissed' WHEN eid % 101 = 0 THEN 'withheld' ELSE st END AS st FROM le WHERE aid % 59 <> 0),
ln AS (SELECT claim_id, count(*) FILTER (stance = 'supports' AND st = 'open') AS n_open_support, count(*) FILTER (stance = 'complicates' AND st = 'open') AS n_oc, count(*) FILTER (stance = 'contradicts' AND st = 'open') AS n_ok,
  count(*) FILTER (stance = 'supports' AND st = 'ai_accepted') AS n_ai_accepted, count(*) FILTER (stance = 'supports' AND st = 'ai_dismissed') AS nd, count(*) FILTER (stance = 'contradicts' AND st = 'ai_accepted') AS nc,
  count(*) FILTER (st = 'withheld') AS n_withheld FROM lx GROUP BY claim_id),
la AS (SELECT o_orderkey - o_orderkey % 3 AS claim_id, count(*) AS na FROM orders WHERE o_orderkey % 59 <> 0 GROUP BY 1),
ls AS (SELECT c.claim_id, CASE WHEN c.claim_id % 53 <> 0 THEN verdict END AS verdict, coalesce(n_open_support, 0) AS n_open_support, coalesce(n_oc, 0) + CASE WHEN coalesce(nc, 0) > 0 THEN 0 ELSE coalesce(n_ok, 0) END AS n_open_against, coalesce(n_ai_accepted, 0) AS n_ai_accepted,
  coalesce(nd, 0) AS nd, coalesce(nc, 0) > 0 AS contradiction, coalesce(n_withheld, 0) AS n_withheld, coalesce(na, 0) = 0 AS untested
  FROM c LEFT JOIN d ON d.claim_id = c.claim_id LEFT JOIN ln ON ln.claim_id = c.claim_id LEFT JOIN la ON la.claim_id = c.claim_id),
st AS (SELECT *, CASE WHEN claim_id % 47 = 0 OR verdict IS NULL THEN 8 ELSE least(CASE WHEN claim_id % 41 = 0 THEN 0 ELSE 9 END, CASE WHEN untested OR n_withheld > 0 OR contradiction THEN 1 ELSE 9 END,
  CASE WHEN n_ai_accepted > 0 THEN CASE WHEN verdict = 'supported' THEN 5 ELSE 1 END ELSE 9 END, CASE WHEN n_open_support > 0 THEN CASE WHEN verdict = 'supported' THEN 5 ELSE 2 END ELSE 9 END,
  CASE WHEN n_open_against > 0 THEN 3 ELSE 9 END, CASE WHEN claim_id % 29 = 0 THEN 4 ELSE 9 END, CASE WHEN nd > 0 THEN 5 ELSE 9 END, CASE WHEN claim_id % 2 <> 0 THEN 6 ELSE 9 END) END::INTEGER AS priority FROM ls)
"""
ORACLES = {
    "q_verdict_rules": f"WITH {_INPUTS} SELECT claim_id, verdict, basis, reasons FROM d",
    "q_invariant_violations": f"""WITH {_INPUTS}, p AS (SELECT claim_id, basis, CASE WHEN claim_id % 50 = 0 THEN 'supported' ELSE verdict END AS verdict FROM d)
SELECT p.claim_id, 'failed_check_ignored' AS rule FROM p WHERE verdict <> 'contradicted' AND EXISTS (SELECT 1 FROM a JOIN k USING (aid) WHERE core AND outcome = 'fail' AND a.claim_id = p.claim_id)
UNION ALL SELECT p.claim_id, 'supported_despite_contradiction' FROM p WHERE verdict = 'supported' AND EXISTS (SELECT 1 FROM a JOIN e USING (aid) WHERE core AND stance = 'contradicts' AND status <> 'dismissed' AND a.claim_id = p.claim_id)
UNION ALL SELECT p.claim_id, 'supported_without_core' FROM p WHERE verdict = 'supported' AND NOT EXISTS (SELECT 1 FROM a WHERE core AND a.claim_id = p.claim_id)
UNION ALL SELECT p.claim_id, 'basis_mismatch' FROM p WHERE (verdict = 'supported') <> (basis IS NOT NULL)""",
    "q_claim_states": f"WITH {_INPUTS}, {_STATES} SELECT claim_id, verdict, n_open_support, n_open_against, n_ai_accepted, n_withheld, contradiction, untested, priority FROM st",
    "q_review_queue": f"WITH {_INPUTS}, {_STATES} SELECT claim_id, priority, row_number() OVER (ORDER BY priority, claim_id) AS place FROM st",
    "q_latest_review": """SELECT o_orderkey AS item, coalesce((SELECT l_returnflag FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 1), 'open') AS status FROM orders""",
    "q_status_counts": f"WITH {_INPUTS} SELECT claim_type, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (verdict = 'unproven') AS unproven FROM d GROUP BY claim_type",
}
