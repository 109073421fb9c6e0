"""The selection audit of paragraphs that quote messages, exhibits that print them, and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators import audit as A
from veriframe.session import stored, table

HOUR = 3_600_000_000


def _messages(spark, sf_dir):
    """Every turn on its own phone; each third conversation also on a second one, seen seconds
    later, without some of its turns and with one more text."""
    key, k = F.col("conv_id") * 1000 + F.col("turn"), F.col("turn")
    t = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    us = F.col("conv_id") * 24 * HOUR + k * (HOUR // 2) + F.floor(k / 3) * HOUR
    rows = t.select(key.alias("key"), "conv_id", "turn", F.col("role").alias("sender"), F.when(key % 41 != 0, us).alias("us"), "text")
    copies = rows.filter("conv_id % 3 = 0 AND key % 7 <> 3").withColumn("us", F.col("us") + F.col("turn") * 7_000_000)
    copies = copies.withColumn("text", F.when(F.col("key") % 7 == 5, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")))
    side = lambda df, name: df.withColumn("source_id", F.lit(name))
    both = side(rows, "a").unionByName(side(copies, "b"))
    return both.select(
        F.concat_ws(":", "source_id", "key").alias("id"), "source_id", F.concat_ws("/", "source_id", "conv_id").alias("thread_id"), "sender", "us", F.concat(F.lit("row/"), "turn").alias("locator"), "text",
        "conv_id", "turn", "key",
    )


def _words(first: int, n: int):
    return F.array_join(F.slice(F.split(F.translate("text", "\"“”:…[]()<>|", ""), r"\s+"), F.lit(first), F.lit(n)), " ")


def _paragraphs(spark, sf_dir):
    """A paragraph for each fourth turn, of one document a conversation."""
    t = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND turn % 4 <> 2")
    said = F.concat(F.lit("The message \""), _words(1, 5), F.lit("\" was answered “yes”, then “"), _words(3, 6), F.lit("” and \" \" and \"Sam Poe\"."))
    return t.select(F.concat(F.lit("p"), F.col("conv_id") * 1000 + F.col("turn")).alias("para_id"), F.concat(F.lit("d"), "conv_id").alias("group_id"), said.alias("text"))


def _quotes(spark, sf_dir):
    p = _paragraphs(spark, sf_dir)
    printed = A.paragraph_quotes(p.select("para_id", "text")).join(p.select("para_id", "group_id"), "para_id")
    printed = printed.select(F.concat_ws("#", "para_id", "seq").alias("quote_id"), F.col("para_id").alias("unit_id"), "group_id", "words", F.lit(True).alias("whole"), F.lit(True).alias("document"))
    t = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND turn % 5 = 2")
    ex = F.concat(F.lit("x"), "conv_id")
    shown = t.select(F.concat_ws("#", ex, "turn").alias("quote_id"), ex.alias("unit_id"), ex.alias("group_id"), F.upper(_words(2, 6)).alias("words"), F.lit(False).alias("whole"), F.lit(False).alias("document"))
    return printed.unionByName(shown)


def _names(spark):
    return spark.sql("SELECT 'Sam  Poe' AS name")


def _found(spark, sf_dir):
    """The quotes, and what is found of their texts and where these land."""
    messages, quotes = _messages(spark, sf_dir), stored(A.by_text(_quotes(spark, sf_dir)))
    found = stored(A.hits(quotes.filter("quote_id = text_id").drop("text_id"), messages, _names(spark)))
    return quotes, found, stored(A.placed(found, messages)), messages


def q_paragraph_quotes(spark, sf_dir):
    return A.paragraph_quotes(_paragraphs(spark, sf_dir).select("para_id", "text")).select("para_id", F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "words")


def q_quote_lookups(spark, sf_dir):
    quotes, found, landed, _ = _found(spark, sf_dir)
    return A.lookups_by_text(quotes, found, landed, _names(spark))


def q_selection_audit(spark, sf_dir):
    quotes, found, landed, messages = _found(spark, sf_dir)
    tagged = messages.filter("key % 11 = 4").select("id")
    return A.audit_by_text(quotes, found, landed, tagged, messages)


def _tagged(messages):
    return messages.filter("key % 11 = 4").select(F.lit("tags").alias("unit_id"), F.lit("tags").alias("group_id"), "id", F.lit(False).alias("settled"))


def q_tagged_passages(spark, sf_dir):
    """Passages of the tags alone; what other quotes pick or may pick is left to chance here."""
    messages = _messages(spark, sf_dir)
    marks = messages.filter("key % 5 = 1").select(F.lit("tags").alias("group_id"), "id", F.when(F.col("key") % 2 == 0, "elsewhere").otherwise("maybe").alias("status"))
    return A.passages(messages, _tagged(messages), marks).drop("of_thread", "of_exchange", "only_here", "only_there", "settled")


def q_passage_rows(spark, sf_dir):
    messages = _messages(spark, sf_dir)
    return A.shown(messages, _tagged(messages), gap_s=3 * 3600, side=1, between=2, least=2).select("unit_id", "thread_id", "exchange", F.col("pos").cast("long").alias("pos"), "role", "id", "more")


def q_message_copies(spark, sf_dir):
    """Copies of a text on another source, among the calls' notes as well as the turns."""
    return A.copy_heads(_messages(spark, sf_dir))


QUERIES = {f.__name__: f for f in (q_paragraph_quotes, q_quote_lookups, q_selection_audit, q_tagged_passages, q_passage_rows, q_message_copies)}

_MESSAGES = """
t AS (SELECT conv_id * 1000 + turn AS key, conv_id, turn, role AS sender, text FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, CASE WHEN key % 41 <> 0 THEN conv_id * 86400000000 + turn * 1800000000 + (turn // 3) * 3600000000 END AS us FROM t),
m AS (SELECT 'a:' || key AS id, 'a' AS source_id, 'a/' || conv_id AS thread_id, sender, us, turn, text, conv_id, key FROM r
  UNION ALL SELECT 'b:' || key, 'b', 'b/' || conv_id, sender, us + turn * 7000000, turn, CASE WHEN key % 7 = 5 THEN text || ' (edited)' ELSE text END, conv_id, key FROM r WHERE conv_id % 3 = 0 AND key % 7 <> 3)
"""


def _laid(gap_us: int) -> str:
    """Messages with their places and exchanges, and the exchanges."""
    return f"""
o AS (SELECT *, row_number() OVER w AS pos, lag(us) OVER w AS before_us FROM m WINDOW w AS (PARTITION BY thread_id ORDER BY us IS NULL, us, turn, id)),
e AS (SELECT *, sum(CASE WHEN before_us IS NULL OR us IS NULL OR us - before_us > {gap_us} THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY pos)::BIGINT AS exchange FROM o),
x AS (SELECT thread_id, exchange, any_value(source_id) AS source_id, count(*) AS n, min(pos) AS a, max(pos) AS b, min(us) AS first_us, max(us) AS last_us FROM e GROUP BY ALL),
y AS (SELECT *, lag(last_us) OVER w AS prev_us, lead(first_us) OVER w AS next_us, lag(n) OVER w IS NULL AS opens, lead(n) OVER w IS NULL AS closes FROM x WINDOW w AS (PARTITION BY thread_id ORDER BY exchange))
"""


# passages of pk (unit_id, group_id, id, settled) with mk (group_id, id, status)
_PASSAGES = """
pp AS (SELECT pk.*, e.* EXCLUDE (id) FROM pk JOIN e USING (id)),
sp AS (SELECT unit_id, group_id, thread_id, exchange, count(*) AS picked, count(*) FILTER (settled) AS settled, min(pos) AS i0, max(pos) AS i1, list(DISTINCT sender) FILTER (sender IS NOT NULL) AS senders FROM pp GROUP BY ALL),
h AS (SELECT sp.*, e.pos, e.sender, CASE WHEN (sp.unit_id, e.id) IN (SELECT unit_id, id FROM pk) THEN 'picked' ELSE coalesce(mk.status, 'out') END AS status
  FROM sp JOIN e USING (thread_id, exchange) LEFT JOIN mk ON mk.group_id = sp.group_id AND mk.id = e.id),
c AS (SELECT unit_id, thread_id, exchange, count(*) FILTER (status = 'out' AND pos < i0) AS before, count(*) FILTER (status = 'out' AND pos > i0 AND pos < i1) AS "between", count(*) FILTER (status = 'out' AND pos > i1) AS after,
  count(*) FILTER (status = 'elsewhere') AS elsewhere, count(*) FILTER (status = 'maybe') AS maybe,
  count(*) FILTER (status = 'out' AND sender IS NOT NULL AND len(senders) > 0 AND NOT list_contains(senders, sender)) AS other_senders FROM h GROUP BY ALL),
ps AS (SELECT unit_id, thread_id, exchange, source_id, n, picked, settled, (i0 - a)::INTEGER AS lead, (b - i1)::INTEGER AS trail, before, "between", after, elsewhere, maybe, other_senders, first_us, last_us, prev_us, next_us, opens, closes
  FROM sp JOIN y USING (thread_id, exchange) JOIN c USING (unit_id, thread_id, exchange))
"""
_TAGS = "pk AS (SELECT 'tags' AS unit_id, 'tags' AS group_id, id, false AS settled FROM m WHERE key % 11 = 4)"
_STRIP = """regexp_split_to_array(translate(text, '"“”:…[]()<>|', ''), '\\s+')"""
_PARAS = f"""
pw AS (SELECT conv_id * 1000 + turn AS key, conv_id, {_STRIP} AS w FROM conversations WHERE text IS NOT NULL AND turn % 4 <> 2),
pa AS (SELECT 'p' || key AS para_id, 'd' || conv_id AS group_id, array_to_string(w[1:5], ' ') AS first, array_to_string(w[3:8], ' ') AS second FROM pw),
pq AS (SELECT para_id, group_id, 13 AS begins, first AS words FROM pa UNION ALL SELECT para_id, group_id, 29 + length(first), 'yes' FROM pa UNION ALL SELECT para_id, group_id, 41 + length(first), second FROM pa
  UNION ALL SELECT para_id, group_id, 56 + length(first) + length(second), 'Sam Poe' FROM pa),
nq AS (SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY begins) AS seq FROM pq WHERE words <> '')
"""
_TOKENS = r"""regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*')"""
_FOLD = r"regexp_replace(replace(lower({}), 'ß', 'ss'), '\s+', ' ', 'g')"
_LETTER, _NONE = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
_ALL_WORDS = r"(' ' || array_to_string(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+'), ' ') || ' ')"
# a match is the quote's fold without closing marks, no word cut; the words of most are enough to be loose
_FOUND = f"""{_PARAS},
xw AS (SELECT conv_id, turn, {_STRIP} AS w FROM conversations WHERE text IS NOT NULL AND turn % 5 = 2),
qq AS (SELECT para_id || '#' || seq AS quote_id, para_id AS unit_id, group_id, trim(words) AS words, true AS document FROM nq
  UNION ALL SELECT 'x' || conv_id || '#' || turn, 'x' || conv_id, 'x' || conv_id, upper(array_to_string(w[2:7], ' ')), false FROM xw),
qr AS (SELECT *, len({_TOKENS.format('words')}) AS n, rtrim({_FOLD.format('trim(words)')}, '.,;:!? ') AS f FROM qq),
qs AS (SELECT *, CASE WHEN words = 'Sam Poe' THEN 'name' WHEN n = 0 THEN 'nothing' WHEN n < 2 THEN 'single' END AS reason, {_ALL_WORDS.format('f')} AS fw FROM qr),
mf AS (SELECT id, source_id, text, us, {_FOLD.format('trim(text)')} AS f, {_ALL_WORDS.format(_FOLD.format('text'))} AS fw, {_TOKENS.format('text')} AS tk FROM m),
ht AS (SELECT quote_id, id, CASE WHEN contains(mf.f, qs.f) AND regexp_matches(mf.f, '(^|{_NONE}|' || CASE WHEN regexp_matches(qs.f, '^{_LETTER}') THEN '^' ELSE '' END || ')' || regexp_escape(qs.f) || CASE WHEN regexp_matches(qs.f, '{_LETTER}$') THEN '($|{_NONE})' ELSE '' END) THEN 'found' ELSE 'loose' END AS how
    FROM qs JOIN mf ON contains(mf.fw, qs.fw) WHERE reason IS NULL
  UNION ALL SELECT quote_id, id, 'whole' FROM qs JOIN mf ON qs.n > 0 AND len(mf.tk) = qs.n AND mf.tk = {_TOKENS.format('qs.words')} WHERE reason IS NOT NULL),
hn AS (SELECT quote_id, count(*) FILTER (how = 'found') AS found, count(*) FILTER (how <> 'found') AS loose FROM ht GROUP BY ALL),
hp AS (SELECT quote_id FROM ht JOIN hn USING (quote_id) JOIN mf USING (id) WHERE loose = 0 GROUP BY quote_id
  HAVING count(*) = 1 OR count(*) <= 4 AND count(DISTINCT regexp_replace(trim(text), '\\s+', ' ', 'g')) = 1 AND count(DISTINCT source_id) = count(*) AND count(us) = count(*) AND max(us) - min(us) <= 120000000),
ld AS (SELECT ht.* FROM ht JOIN hp USING (quote_id)),
lc AS (SELECT quote_id, count(*) AS places FROM ld GROUP BY ALL)
"""
_COPIES = """
pr AS (SELECT *, row_number() OVER (PARTITION BY unit_id, thread_id, exchange ORDER BY pos) AS k, regexp_replace(trim(text), '\\s+', ' ', 'g') AS body FROM pp),
pc AS (SELECT x.unit_id, x.thread_id, x.exchange, p.thread_id AS of_thread, p.exchange AS of_exchange, any_value(p.source_id) AS of_source, any_value(x.source_id) AS source, count(*) AS same FROM pr x JOIN pr p ON x.unit_id = p.unit_id AND x.source_id <> p.source_id AND x.k = p.k AND x.body = p.body AND abs(x.us - p.us) <= 120000000 GROUP BY ALL),
pd AS (SELECT pc.unit_id, pc.thread_id, pc.exchange, of_thread, of_exchange FROM pc JOIN ps x ON (x.unit_id, x.thread_id, x.exchange) = (pc.unit_id, pc.thread_id, pc.exchange) JOIN ps p ON (p.unit_id, p.thread_id, p.exchange) = (pc.unit_id, of_thread, of_exchange)
  WHERE same = x.picked AND same = p.picked AND (p.first_us, of_source) < (x.first_us, source)),
bg AS (SELECT thread_id, exchange, text AS body, count(*) AS n FROM e GROUP BY ALL),
bd AS (SELECT unit_id, thread_id, exchange, of_thread, of_exchange, body, sum(d) AS d FROM (
  SELECT pd.*, body, n AS d FROM pd JOIN bg USING (thread_id, exchange) UNION ALL SELECT pd.*, body, -n FROM pd JOIN bg ON (bg.thread_id, bg.exchange) = (of_thread, of_exchange)) GROUP BY ALL),
be AS (SELECT unit_id, thread_id, exchange, of_thread, of_exchange, sum(greatest(d, 0))::BIGINT AS only_here, sum(greatest(-d, 0))::BIGINT AS only_there FROM bd GROUP BY ALL)
"""
ORACLES = {
    "q_quote_lookups": f"""WITH {_MESSAGES}, {_FOUND} SELECT quote_id, reason, coalesce(found, 0) AS found, coalesce(loose, 0) AS loose, false AS part, coalesce(places, 0) AS places FROM qs LEFT JOIN hn USING (quote_id) LEFT JOIN lc USING (quote_id)""",
    "q_selection_audit": f"""WITH {_MESSAGES}, {_laid(3_600_000_000)}, {_FOUND},
la AS (SELECT unit_id, group_id, id, document FROM ld JOIN qq USING (quote_id)),
pk AS (SELECT DISTINCT unit_id, group_id, id, id IN (SELECT id FROM la WHERE document) AS settled FROM (SELECT unit_id, group_id, id FROM la UNION ALL SELECT 'tags', 'tags', id FROM m WHERE key % 11 = 4)),
mk AS (SELECT group_id, id, min(status) AS status FROM (SELECT group_id, id, 'elsewhere' AS status FROM la UNION ALL SELECT group_id, id, 'maybe' FROM ht JOIN qq USING (quote_id)) GROUP BY ALL),
{_PASSAGES}, {_COPIES} SELECT ps.*, of_thread, of_exchange, only_here, only_there FROM ps LEFT JOIN be USING (unit_id, thread_id, exchange) WHERE unit_id <> 'tags' OR settled < picked""",
    "q_paragraph_quotes": f"WITH {_PARAS} SELECT para_id, seq, begins::BIGINT AS start_at, (begins + length(words))::BIGINT AS end_at, trim(words) AS words FROM nq",
    "q_tagged_passages": f"""WITH {_MESSAGES}, {_laid(3_600_000_000)}, {_TAGS}, mk AS (SELECT 'tags' AS group_id, id, CASE WHEN key % 2 = 0 THEN 'elsewhere' ELSE 'maybe' END AS status FROM m WHERE key % 5 = 1), {_PASSAGES}
SELECT * EXCLUDE (settled) FROM ps""",
    "q_passage_rows": f"""WITH {_MESSAGES}, {_laid(10_800_000_000)}, {_TAGS}, pp AS (SELECT unit_id, e.* FROM pk JOIN e USING (id)),
sp AS (SELECT unit_id, thread_id, exchange, min(pos) AS i0, max(pos) AS i1 FROM pp GROUP BY ALL),
i AS (SELECT sp.*, a, b, e.id, e.pos, e.id IN (SELECT id FROM pk) AS pick FROM sp JOIN y USING (thread_id, exchange) JOIN e USING (thread_id, exchange)),
j AS (SELECT *, coalesce(max(CASE WHEN pick THEN pos END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p, min(CASE WHEN pick THEN pos END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM i WINDOW w AS (PARTITION BY unit_id, thread_id, exchange ORDER BY pos)),
k AS (SELECT *, CASE WHEN pick THEN 'picked' WHEN pos < i0 THEN 'before' WHEN pos > i1 THEN 'after' ELSE 'between' END AS role FROM j),
l AS (SELECT *, CASE role WHEN 'picked' THEN true WHEN 'before' THEN pos >= i0 - 1 WHEN 'after' THEN pos <= i1 + 1 ELSE q - p - 1 <= 2 OR pos = p + 1 OR pos = q - 1 END AS kept FROM k)
SELECT unit_id, thread_id, exchange, pos, role, id, 0::BIGINT AS more FROM l WHERE kept
UNION ALL SELECT unit_id, thread_id, exchange, min(pos), role, NULL, count(*) FROM l WHERE NOT kept GROUP BY unit_id, thread_id, exchange, role, p
UNION ALL SELECT unit_id, thread_id, sp.exchange, e.pos, CASE WHEN e.pos < a THEN 'earlier' ELSE 'later' END, e.id, 0 FROM sp JOIN y USING (thread_id, exchange) JOIN e USING (thread_id)
  WHERE e.pos < a AND e.pos >= a - (2 - (i0 - a)) OR e.pos > b AND e.pos <= b + (2 - (b - i1))""",
}
