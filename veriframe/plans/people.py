"""Identity, integrity, activity and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators import activity as A
from veriframe.operators import identity as I
from veriframe.operators import integrity as G
from veriframe.session import table
from veriframe.sources import adapter


def _accounts(spark, sf_dir):
    c = F.col("c_custkey")
    number = F.concat(F.lit("(212) 55"), F.lpad((c % 700).cast("string"), 5, "0"))
    number = F.when(c % 2 == 0, F.regexp_replace(number, r"[() ]", "")).otherwise(number)
    app = F.element_at(F.array(F.lit("SMS"), F.lit("Calls"), F.lit("Email"), F.lit("chat")), (c % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        c.alias("id"), app.alias("app"), F.when(c % 4 < 2, number).otherwise(F.concat(F.when(c % 8 == 2, "User").otherwise("user"), (c % 600).cast("string"))).alias("identifier"),
        F.when(c % 9 == 0, F.col("c_nationkey")).alias("device_id"), F.concat(F.lit("name"), (c % 500).cast("string")).alias("display_name"),
    )


def q_account_keys(spark, sf_dir):
    composed = T.nfc(F.concat("identifier", F.when(F.col("id") % 5 == 0, "e\u0301").otherwise("")))
    return _accounts(spark, sf_dir).groupBy(I.account_key(F.col("app"), composed).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def q_person_accounts(spark, sf_dir):
    a = _accounts(spark, sf_dir)
    links = a.select(F.col("id").alias("account_id"), (F.col("id") % 40).alias("person_id"), F.when(F.col("id") % 5 == 0, "confirmed").when(F.col("id") % 5 == 1, "proposed").otherwise("rejected").alias("status"))
    k = F.col("n_nationkey")
    owners = table(spark, sf_dir, "nation").select(k.alias("device_id"), (k.cast("long") % 40).alias("person_id"), F.when(k % 3 == 0, "confirmed").otherwise("proposed").alias("status"))
    return I.person_accounts(a, links, owners)


def q_same_account(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    handles = o.select(k.alias("claim_id"), F.explode(F.array(F.concat(F.lit("NAME"), (k % 520).cast("string")), F.concat(F.lit("user"), (k % 610).cast("string")))).alias("handle"))
    return I.same_account(handles, _accounts(spark, sf_dir))


def q_contact_entry(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    contacts = p.select(k.alias("id"), F.concat(F.lit("item"), (k % 4).cast("string")).alias("source_id"), F.concat(F.lit(" "), "p_brand").alias("name"), F.concat(F.lit("+1 212-"), (k % 300).cast("string")).alias("identifier"))
    claims = p.select(k.alias("claim_id"), F.concat(F.lit("item"), (k % 4).cast("string")).alias("source_id"), F.col("p_brand").alias("name"), F.concat(F.lit("+1(212)"), (k % 450).cast("string")).alias("number"))
    return I.contact_entry(claims, contacts)


def q_name_level(spark, sf_dir):
    k = F.col("p_partkey")
    persons = table(spark, sf_dir, "part").select(k.alias("person_id"), F.when(k % 5 == 0, F.element_at(F.split("p_name", " "), 1)).otherwise(F.upper("p_name")).alias("name"))
    word = F.element_at(F.split("p_name", " "), (k % 2 + 1).cast("int"))
    seen = table(spark, sf_dir, "part").select(k.alias("account"), F.when(k % 7 == 0, F.left(word, F.lit(4))).when(k % 7 == 1, F.concat(F.col("p_name"), F.lit(" jr"))).otherwise(word).alias("seen_name"))
    return I.name_candidates(persons, seen)


def q_link_proposal_diff(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    stored = c.filter(k % 3 != 0).select((k % 50).alias("person_id"), k.alias("account"), F.when(k % 4 == 0, "confirmed").otherwise("proposed").alias("status"))
    return I.proposal_diff(stored, c.filter(k % 5 != 0).select((k % 50).alias("person_id"), k.alias("account")))


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return G.build_chain(e.select(
        "user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.concat(F.lit("user \\"), "user_id", F.lit('"')).alias("actor"), F.col("event_type").alias("action"), F.col("props").alias("payload")
    ), "user_id", "event_id")


def q_hash_chain_break(spark, sf_dir):
    """Logs with an edited payload, with withheld entries, and with both."""
    u, seq = F.col("user_id"), F.col("seq")
    edited = F.when((u % 3 == 0) & (seq == u % 20 + 6), F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    return G.first_break(G.withhold(_log(spark, sf_dir).withColumn("payload", edited), (u % 2 == 0) & (seq % 10 == 7)), "user_id")


def q_hash_chain_heads(spark, sf_dir):
    return G.heads(_log(spark, sf_dir), "user_id")


def q_lost_anchors(spark, sf_dir):
    log = _log(spark, sf_dir)
    anchors = log.filter("seq % 8 = 0").select("user_id", "seq", F.when(F.col("seq") % 24 == 0, F.lit("0")).otherwise(F.col("hash")).alias("hash"))
    return G.lost_anchors(anchors, log, "user_id").select("user_id", "seq")


def q_log_reconcile(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    logged = o.filter(k % 7 != 0).select(k.alias("item"), F.when(k % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"))
    return G.reconcile(logged, o.filter(k % 13 != 0).select(k.alias("item"), F.col("o_orderstatus").alias("status")), "item", "status")


def q_row_digest(spark, sf_dir):
    return G.rows_digest(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"])


def q_dangling_references(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.when(F.col("l_partkey") % 50 == 0, 10_000_000).otherwise(0)).alias("ref"))
    return G.dangling(li, "ref", table(spark, sf_dir, "part"), "p_partkey")


def _steps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), adapter.micros(F.col("ts")).alias("us"), F.when(F.col("event_type") == "purchase", "action").otherwise("view").alias("kind"), (F.col("event_id") % 40).alias("page"))


def q_time_on_page(spark, sf_dir):
    return A.time_on_page(_steps(spark, sf_dir))


def q_activity_by_claim(spark, sf_dir):
    return A.by_page(A.time_on_page(_steps(spark, sf_dir)))


def q_refresh_suppression(spark, sf_dir):
    return A.refreshes(_steps(spark, sf_dir).withColumn("page", F.col("page") % 3), 7200).select("session", "seq")


def q_flag_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("target"), F.col("event_type").alias("flag"), "event_id")
    last = e.groupBy("target").agg(F.max_by("flag", "event_id").alias("flag"))
    return last.groupBy("flag").agg(F.count("*").alias("n"))


def q_error_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return A.error_log(o.select(F.col("o_orderpriority").alias("pilot"), (F.col("o_orderstatus") != "P").alias("complete"), (F.col("o_orderkey") % 20).alias("claims"), (F.col("o_orderkey") % 3).alias("flags")))


def _scored(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    gold = o.select(k.alias("claim_id"), F.col("o_orderstatus").alias("verdict"))
    said = o.filter(k % 17 != 0).select(k.alias("claim_id"), F.when(k % 6 == 0, "F").otherwise(F.col("o_orderstatus")).alias("verdict"))
    return A.scored(gold, said, "claim_id", "verdict").join(o.select(k.alias("claim_id"), F.col("o_orderpriority").alias("claim_type")), "claim_id")


def q_confusion(spark, sf_dir):
    return A.confusion(_scored(spark, sf_dir))


def q_wilson_rates(spark, sf_dir):
    return A.rates(_scored(spark, sf_dir), "claim_type")


def q_loss_funnel(spark, sf_dir):
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    return A.funnel(li.select((n % 2 == 0).alias("retrieved"), (n % 4 == 0).alias("shown"), (n % 12 == 0).alias("labelled"), (n % 60 == 0).alias("settled")), ["retrieved", "shown", "labelled", "settled"])


def q_run_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return A.run_profile(e.select((F.col("event_id") % 37).alias("job"), F.col("event_id").alias("seq"), adapter.micros(F.col("ts")).alias("us"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome")), "job", 7_200_000_000)


QUERIES = {f.__name__: f for f in (
    q_account_keys, q_person_accounts, q_same_account, q_contact_entry, q_name_level, q_link_proposal_diff, q_hash_chain_break, q_hash_chain_heads, q_lost_anchors, q_log_reconcile, q_row_digest, q_dangling_references,
    q_time_on_page, q_activity_by_claim, q_refresh_suppression, q_flag_latest, q_error_log, q_confusion, q_wilson_rates, q_loss_funnel, q_run_profile,
)}

_ROW = "sha256('[' || " + " || ', ' || ".join(f"""'"' || {c} || '"'""" for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")) + " || ']')"
_ACC = r"""
acc AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'SMS' WHEN 1 THEN 'Calls' WHEN 2 THEN 'Email' ELSE 'chat' END AS app,
  CASE WHEN c_custkey % 4 < 2 THEN CASE WHEN c_custkey % 2 = 0 THEN '21255' ELSE '(212) 55' END || lpad((c_custkey % 700)::VARCHAR, 5, '0')
       ELSE CASE WHEN c_custkey % 8 = 2 THEN 'User' ELSE 'user' END || (c_custkey % 600) END AS identifier,
  CASE WHEN c_custkey % 9 = 0 THEN c_nationkey END AS device_id, 'name' || (c_custkey % 500) AS display_name FROM customer),
ak AS (SELECT *, CASE WHEN lower(app) IN ('sms', 'calls') THEN 'tel:' || regexp_replace(identifier, '[\s().\-]', '', 'g') WHEN lower(app) = 'email' THEN 'email:' || lower(identifier) ELSE lower(app) || ':' || identifier END AS key FROM acc)
"""
_VISITS = """
st AS (SELECT user_id AS session, event_id AS seq, epoch_us(ts) AS us, event_id % 40 AS page FROM events WHERE event_type <> 'purchase'),
vi AS (SELECT *, lead(us) OVER (PARTITION BY session ORDER BY us, seq) - us AS gap FROM st),
vs AS (SELECT session, seq, page, CASE WHEN gap <= 1800000000 THEN gap // 1000000 END AS seconds, coalesce(gap > 1800000000, false) AS away FROM vi)
"""
_LOG = r"""lg AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, to_json(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS stamp, to_json('user \' || user_id || '"') AS actor,
  to_json(event_type) AS action, to_json(props::VARCHAR) AS payload FROM events)"""
_SCORED = """sc AS (SELECT o_orderkey AS claim_id, o_orderpriority AS claim_type, o_orderstatus AS gold, CASE WHEN o_orderkey % 17 = 0 THEN 'missing' WHEN o_orderkey % 6 = 0 THEN 'F' ELSE o_orderstatus END AS predicted FROM orders)"""
ORACLES = {
    "q_account_keys": f"""WITH {_ACC} SELECT key || CASE WHEN id % 5 = 0 THEN nfc_normalize('e' || chr(769)) ELSE '' END AS key, count(*) AS n, min(id) AS first_id FROM ak GROUP BY 1""",
    "q_person_accounts": f"""WITH {_ACC}, k AS (SELECT n_nationkey % 40 AS person_id, key FROM nation JOIN ak ON ak.device_id = n_nationkey WHERE n_nationkey % 3 = 0
UNION SELECT id % 40, key FROM ak WHERE id % 5 = 0) SELECT DISTINCT person_id::BIGINT AS person_id, id FROM k JOIN ak USING (key)""",
    "q_same_account": f"""WITH {_ACC}, nm AS (SELECT key, lower(identifier) AS name FROM ak UNION SELECT key, lower(display_name) FROM ak),
h AS (SELECT o_orderkey AS claim_id, unnest(['NAME' || (o_orderkey % 520), 'user' || (o_orderkey % 610)]) AS handle FROM orders),
r AS (SELECT claim_id, handle, count(DISTINCT key) AS nk, min(key) AS key FROM h LEFT JOIN nm ON nm.name = lower(handle) GROUP BY claim_id, handle),
s AS (SELECT claim_id, count(*) AS n_handles, count(*) FILTER (nk = 1) AS n_resolved, count(DISTINCT CASE WHEN nk = 1 THEN key END) AS n_keys FROM r GROUP BY claim_id)
SELECT *, CASE WHEN n_handles = n_resolved AND n_keys = 1 THEN 'pass' WHEN n_handles = n_resolved THEN 'fail' ELSE 'inconclusive' END AS outcome FROM s""",
    "q_contact_entry": """WITH c AS (SELECT p_partkey % 4 AS s, p_brand AS name, '+1212' || (p_partkey % 300) AS key FROM part),
n AS (SELECT p_partkey AS claim_id, (SELECT count(*) FROM c WHERE c.s = p_partkey % 4 AND c.name = p_brand AND c.key = '+1212' || (p_partkey % 450)) AS n FROM part)
SELECT claim_id, n, CASE WHEN n > 0 THEN 'pass' ELSE 'inconclusive' END AS outcome FROM n""",
    "q_name_level": r"""WITH w AS (SELECT p_partkey AS k, p_name, string_split(p_name, ' ')[p_partkey % 2 + 1] AS word FROM part),
pn AS (SELECT CASE WHEN k % 5 = 0 THEN string_split(p_name, ' ')[1] ELSE upper(p_name) END AS name, count(*) AS n_persons FROM w GROUP BY 1),
sn AS (SELECT CASE k % 7 WHEN 0 THEN left(word, 4) WHEN 1 THEN p_name || ' jr' ELSE word END AS seen_name, count(*) AS n_accounts FROM w GROUP BY 1),
p AS (SELECT *, list_filter(regexp_extract_all(lower(name), '(\p{L}+)'), lambda w: length(w) >= 2) AS pw FROM pn),
s AS (SELECT *, list_filter(regexp_extract_all(lower(seen_name), '(\p{L}+)'), lambda w: length(w) >= 2) AS sw FROM sn),
l AS (SELECT name, seen_name, n_persons, n_accounts, CASE WHEN len(pw) = 0 THEN NULL WHEN len(pw) > 1 AND list_has_all(sw, pw) THEN 'full' WHEN len(pw) = 1 AND list_contains(sw, pw[1]) THEN 'name'
  WHEN len(pw) > 1 AND list_contains(sw, pw[-1]) THEN 'surname' WHEN len(pw) > 1 AND list_contains(sw, pw[1]) THEN 'first'
  WHEN len(list_filter(sw, lambda w: w <> pw[1] AND least(length(w), length(pw[1])) >= 3 AND (starts_with(pw[1], w) OR starts_with(w, pw[1])))) > 0 THEN 'short' END AS level FROM p, s)
SELECT * FROM l WHERE level IS NOT NULL""",
    "q_link_proposal_diff": """SELECT (c_custkey % 50)::BIGINT AS person_id, c_custkey AS account, CASE WHEN c_custkey % 3 = 0 THEN 'added' ELSE 'removed' END AS change FROM customer
WHERE (c_custkey % 3 = 0 AND c_custkey % 5 <> 0) OR (c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 5 = 0)""",
    "q_hash_chain_break": """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
b AS (SELECT user_id, n, CASE WHEN user_id % 2 = 0 THEN (n + 3) // 10 ELSE 0 END AS n_withheld, user_id % 20 + 6 AS brk FROM n)
SELECT user_id, n, n_withheld, CASE WHEN user_id % 3 = 0 AND brk <= n AND NOT (user_id % 2 = 0 AND brk % 10 = 7) THEN brk::INTEGER END AS first_break FROM b""",
    "q_hash_chain_heads": f"""WITH RECURSIVE {_LOG}, c AS (SELECT user_id, 0::BIGINT AS seq, '' AS h FROM (SELECT DISTINCT user_id FROM lg) UNION ALL
SELECT lg.user_id, lg.seq, sha256('[' || to_json(c.h) || ', ' || stamp || ', ' || actor || ', ' || action || ', ' || payload || ']') FROM c JOIN lg ON lg.user_id = c.user_id AND lg.seq = c.seq + 1)
SELECT user_id, max(seq) AS n, arg_max(h, seq) AS head FROM c GROUP BY user_id""",
    "q_lost_anchors": f"WITH {_LOG} SELECT user_id, seq::INTEGER AS seq FROM lg WHERE seq % 24 = 0",
    "q_log_reconcile": """SELECT o_orderkey AS item, CASE WHEN o_orderkey % 13 = 0 THEN 'not_stored' WHEN o_orderkey % 7 = 0 THEN 'not_logged' ELSE 'differs' END AS problem FROM orders
WHERE (o_orderkey % 13 = 0 AND o_orderkey % 7 <> 0) OR (o_orderkey % 7 = 0 AND o_orderkey % 13 <> 0) OR (o_orderkey % 7 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 11 = 0)""",
    "q_row_digest": f"SELECT l_orderkey, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT l_orderkey, {_ROW} AS h FROM lineitem) GROUP BY l_orderkey",
    "q_dangling_references": "SELECT l_orderkey, l_linenumber, l_partkey + 10000000 AS ref FROM lineitem WHERE l_partkey % 50 = 0",
    "q_time_on_page": f"WITH {_VISITS} SELECT * FROM vs",
    "q_activity_by_claim": f"WITH {_VISITS} SELECT page, count(*) AS opens, sum(coalesce(seconds, 0))::BIGINT AS seconds, count(*) FILTER (away) AS n_away, count(*) FILTER (seconds IS NULL AND NOT away) AS n_untimed, count(DISTINCT session) AS sessions FROM vs GROUP BY page",
    "q_refresh_suppression": """WITH v AS (SELECT user_id AS session, event_id AS seq, epoch_us(ts) AS us, event_id % 40 % 3 AS page FROM events WHERE event_type <> 'purchase'),
w AS (SELECT *, lag(page) OVER p AS lp, us - lag(us) OVER p AS gap FROM v WINDOW p AS (PARTITION BY session ORDER BY us, seq)) SELECT session, seq FROM w WHERE NOT coalesce(lp = page AND gap <= 7200000000, false)""",
    "q_flag_latest": "SELECT flag, count(*) AS n FROM (SELECT event_id % 500 AS target, arg_max(event_type, event_id) AS flag FROM events GROUP BY 1) GROUP BY flag",
    "q_error_log": """WITH t AS (SELECT o_orderpriority AS pilot, count(*) FILTER (o_orderstatus <> 'P') AS n_cases, count(*) FILTER (o_orderstatus = 'P') AS n_left_out, coalesce(sum(o_orderkey % 20) FILTER (o_orderstatus <> 'P'), 0)::BIGINT AS claims,
  coalesce(sum(o_orderkey % 3) FILTER (o_orderstatus <> 'P'), 0)::BIGINT AS flags FROM orders GROUP BY 1) SELECT *, CASE WHEN claims > 0 THEN round(flags / claims, 9) END AS rate FROM t""",
    "q_confusion": f"WITH {_SCORED} SELECT gold, predicted, count(*) AS n FROM sc GROUP BY gold, predicted",
    "q_wilson_rates": f"""WITH {_SCORED}, t AS (SELECT claim_type, count(*) FILTER (gold = predicted) AS k, count(*) AS n, 1.959964::DOUBLE AS z FROM sc GROUP BY claim_type),
i AS (SELECT *, (k / n + z * z / (2 * n)) / (1 + z * z / n) AS c, z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM t)
SELECT claim_type, k, n, round(least(1, greatest(0, c - h)), 9) AS lo, round(least(1, greatest(0, c + h)), 9) AS hi FROM i""",
    "q_loss_funnel": "SELECT CASE WHEN l_partkey % 60 = 0 THEN 'settled' WHEN l_partkey % 12 = 0 THEN 'labelled' WHEN l_partkey % 4 = 0 THEN 'shown' WHEN l_partkey % 2 = 0 THEN 'retrieved' ELSE 'not_reached' END AS stage, count(*) AS n FROM lineitem GROUP BY 1",
    "q_run_profile": """WITH c AS (SELECT event_id % 37 AS job, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_id % 37 ORDER BY ts, event_id) AS gap, event_type = 'error' AS bad FROM events)
SELECT job, count(*) AS n, coalesce(sum(gap) FILTER (gap <= 7200000000), 0)::BIGINT // 1000000 AS busy_s, count(*) FILTER (NOT bad) AS n_ok, count(*) FILTER (bad) AS n_other FROM c GROUP BY job""",
}
