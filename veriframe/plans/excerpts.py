"""Excerpts placed in messages, and folds with their offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators import excerpts as X
from veriframe.operators.statements import omitted
from veriframe.session import table


def _bodies(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("body"))


def _excerpts(spark, sf_dir):
    """Every message as an exhibit prints it: with a label, in quotation marks, words left out, some shouted."""
    words, k = F.split("body", " "), F.col("id")
    n = F.size(words)
    first, last = F.array_join(F.slice(words, F.lit(1), F.lit(3)), " "), F.array_join(F.slice(words, F.greatest(n - 1, F.lit(1)), F.lit(2)), " ")
    said = F.when(n < 6, F.col("body")).otherwise(F.concat(first, F.lit(" … "), last))
    said = F.when(k % 3 == 1, F.upper(said)).when(k % 3 == 2, F.replace(said, F.lit(" "), F.lit("  "))).otherwise(said)
    return _bodies(spark, sf_dir).select(k.alias("excerpt_id"), F.concat(F.lit("3/12/2026 4:15 PM PETROV: “"), said, F.lit("”")).alias("excerpt"))


def q_fold_spans(spark, sf_dir):
    """The tolerant fold of every message, and whether its map leads back to the message's ends."""
    f = F.col("f")
    text = F.concat(F.lit("  ‘"), "body", F.lit("—’ \n"))
    rows = _bodies(spark, sf_dir).withColumn("text", text).withColumn("f", X.tolerant("text"))
    n = F.size(f.starts)
    whole = (F.get(f.starts, F.lit(0)) == 2) & (F.get(f.ends, n - 1) == F.length("text") - 2) & (n == F.length(f.text)) & (F.size(f.ends) == n)
    return rows.select("id", F.md5(f.text).alias("folded"), n.alias("n"), whole.alias("mapped"))


def q_excerpt_parts(spark, sf_dir):
    """How many parts each excerpt is looked for by, and how many pieces the fullest has."""
    p = F.col("p")
    rows = _excerpts(spark, sf_dir).select("excerpt_id", X.parts("excerpt").alias("p"))
    return rows.select("excerpt_id", F.size(p).alias("n_parts"), F.size(F.get(p, F.lit(0)).ranges).alias("n_pieces"))


def q_excerpt_matches(spark, sf_dir):
    return X.find(X.placed(_excerpts(spark, sf_dir), _bodies(spark, sf_dir)), 5).select("excerpt_id", "id", "method", F.col("no").cast("long").alias("no"), "total", "dropped")


def q_excerpt_every(spark, sf_dir):
    return X.find_every(X.placed(_excerpts(spark, sf_dir), _bodies(spark, sf_dir))).select("excerpt_id", "id", "method", "total")


def q_excerpt_omissions(spark, sf_dir):
    """What the excerpt of each message leaves out of that message."""
    found = X.find_own(_excerpts(spark, sf_dir), _bodies(spark, sf_dir)).withColumnRenamed("excerpt_id", "id").join(_bodies(spark, sf_dir), "id")
    return found.select("id", F.array_join(omitted(F.col("body"), F.col("spans")), "|").alias("left_out"))


QUERIES = {f.__name__: f for f in (q_fold_spans, q_excerpt_parts, q_excerpt_matches, q_excerpt_every, q_excerpt_omissions)}

# the same excerpts, and placement as a regular expression: pieces in order, no word cut
_W = r"[\p{L}\p{N}_]"
_N = r"[^\p{L}\p{N}_]"
_SAID = f"""
b AS (SELECT conv_id * 1000 + turn AS id, text AS body, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL),
s AS (SELECT id, len(w) < 6 AS whole, CASE WHEN len(w) < 6 THEN body ELSE array_to_string(w[1:3], ' ') END AS p, CASE WHEN len(w) >= 6 THEN array_to_string(w[-2:], ' ') END AS q FROM b),
v AS (SELECT id, whole, CASE id % 3 WHEN 1 THEN upper(p) WHEN 2 THEN replace(p, ' ', '  ') ELSE p END AS p, CASE id % 3 WHEN 1 THEN upper(q) WHEN 2 THEN replace(q, ' ', '  ') ELSE q END AS q FROM s),
lw AS (SELECT id, body, regexp_replace(lower(trim(body)), '\\s+', ' ', 'g') AS low FROM b),
lv AS (SELECT id, p, q, regexp_replace(lower(p), '\\s+', ' ', 'g') AS lp, regexp_replace(lower(q), '\\s+', ' ', 'g') AS lq FROM v)
"""


def _pattern(p: str, q: str) -> str:
    begins, ends = (lambda x: f"regexp_matches({x}, '^{_W}')"), (lambda x: f"regexp_matches({x}, '{_W}$')")
    lead = f"CASE WHEN {begins(p)} THEN '(^|{_N})' ELSE '' END"
    tail = f"CASE WHEN {ends(f'coalesce({q}, {p})')} THEN '($|{_N})' ELSE '' END"
    gap = f"""CASE WHEN {ends(p)} AND {begins(q)} THEN '{_N}(.*{_N})?' WHEN {begins(q)} THEN '(.*{_N})?' WHEN {ends(p)} THEN '({_N}.*)?' ELSE '.*' END"""
    return f"'(?s)' || {lead} || regexp_escape({p}) || coalesce({gap} || regexp_escape({q}), '') || {tail}"


_MATCHED = f"""{_SAID},
x AS (SELECT lv.id AS excerpt_id, lw.id AS id, 0 AS m FROM lv JOIN lw ON contains(body, p) AND (q IS NULL OR contains(body, q)) WHERE regexp_matches(body, {_pattern('p', 'q')})),
y AS (SELECT lv.id AS excerpt_id, lw.id AS id, 1 AS m FROM lv JOIN lw ON contains(low, lp) AND (lq IS NULL OR contains(low, lq)) WHERE regexp_matches(low, {_pattern('lp', 'lq')})),
z AS (SELECT excerpt_id, id, min(m) AS m FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY ALL)
"""
ORACLES = {
    "q_fold_spans": r"""SELECT conv_id * 1000 + turn AS id, md5(f) AS folded, length(f)::INTEGER AS n, true AS mapped
FROM (SELECT conv_id, turn, '''' || regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g') || '-''' AS f FROM conversations)""",
    "q_excerpt_parts": f"WITH {_SAID} SELECT id AS excerpt_id, (2 + CASE WHEN regexp_matches(coalesce(q, p), '[.,;:!?]$') THEN 1 ELSE 0 END)::INTEGER AS n_parts, CASE WHEN whole THEN 1 ELSE 2 END::INTEGER AS n_pieces FROM v",
    "q_excerpt_matches": f"""WITH {_MATCHED}, f AS (SELECT *, min(m) OVER (PARTITION BY excerpt_id) AS best FROM z),
g AS (SELECT excerpt_id, id, CASE m WHEN 0 THEN 'exact' ELSE 'tolerant' END AS method, row_number() OVER (PARTITION BY excerpt_id ORDER BY id) AS no, count(*) OVER (PARTITION BY excerpt_id) AS total, 0::BIGINT AS dropped FROM f WHERE m = best)
SELECT * FROM g WHERE no <= 5""",
}
