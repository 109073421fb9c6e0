"""Queries over quoted words and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators import quotes as Q
from veriframe.session import table
from veriframe.sources import adapter
from veriframe.sources.adapter import with_views


def _quotes(spark, sf_dir):
    """The first words of every benchmark passage, some of them shouted or with wide gaps."""
    first = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    k = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(k.alias("quote_id"), F.when(k % 3 == 1, F.upper(first)).when(k % 3 == 2, F.replace(first, F.lit(" "), F.lit("  "))).otherwise(first).alias("quote"))


def _bodies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))


def q_quote_exact_contains(spark, sf_dir):
    return Q.find_quotes(_quotes(spark, sf_dir), _bodies(spark, sf_dir)).filter("method = 'exact'").select("quote_id", "id")


def q_quote_cascade(spark, sf_dir):
    return Q.cascade(Q.find_quotes(_quotes(spark, sf_dir), _bodies(spark, sf_dir)), 5)


def q_same_words_run(spark, sf_dir):
    return Q.same_words(_quotes(spark, sf_dir), _bodies(spark, sf_dir))


def q_keyword_score_topk(spark, sf_dir):
    terms = F.array_distinct(T.tokens(F.col("text")))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))
    bodies = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("body"))
    return Q.keyword_score(queries, bodies, 5)


def q_retrieval_search(spark, sf_dir):
    claims = adapter.claims(spark, sf_dir).select(F.col("claim_id").alias("query_id"), F.array("a", "b").alias("sides"), F.array("quote").alias("terms"), "lo", "hi")
    return Q.retrieve(claims, adapter.records(spark, sf_dir), 10)


def q_text_folds(spark, sf_dir):
    t = F.concat(F.lit("‘"), "text", F.lit("’"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(T.quote_fold(t)).alias("quote_fold"), F.md5(T.space_fold(t)).alias("space_fold"), F.md5(T.alias_key(t)).alias("alias_key"), F.size(T.tokens(t)).cast("long").alias("n_tokens")
    )


QUERIES = {f.__name__: f for f in (q_quote_exact_contains, q_quote_cascade, q_same_words_run, q_keyword_score_topk, q_retrieval_search, q_text_folds)}

_QUOTES = r"""
q0 AS (SELECT item_id AS quote_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS f FROM benchmark),
q AS (SELECT quote_id, CASE quote_id % 3 WHEN 1 THEN upper(f) WHEN 2 THEN replace(f, ' ', '  ') ELSE f END AS quote FROM q0),
d AS (SELECT doc_id AS id, text AS body FROM documents),
e AS (SELECT quote_id, quote, CASE WHEN regexp_matches(quote, '^[\p{L}\p{N}_]') THEN '(^|[^\p{L}\p{N}_])' ELSE '' END AS pre,
      CASE WHEN regexp_matches(quote, '[\p{L}\p{N}_]$') THEN '($|[^\p{L}\p{N}_])' ELSE '' END AS post FROM q),
x AS (SELECT quote_id, id, 0 AS rank FROM e JOIN d ON contains(body, quote) WHERE regexp_matches(body, pre || regexp_escape(quote) || post)),
l AS (SELECT quote_id, pre, post, regexp_replace(replace(replace(lower(quote), 'ς', 'σ'), 'ß', 'ss'), '\s+', ' ', 'g') AS quote FROM e),
b AS (SELECT id, regexp_replace(translate(replace(replace(lower(trim(body)), 'ς', 'σ'), 'ß', 'ss'), '‘’“”', '''''""'), '\s+', ' ', 'g') AS body FROM d),
y AS (SELECT quote_id, id, 1 AS rank FROM l JOIN b ON contains(body, quote) WHERE regexp_matches(body, pre || regexp_escape(quote) || post)),
m AS (SELECT quote_id, id, min(rank) AS rank FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY quote_id, id)
"""
_WORDS = r"' ' || array_to_string(regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*)'), ' ') || ' '"
_TOKENS = r"regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*)')"
_FOLD = "replace(replace({}, 'ς', 'σ'), 'ß', 'ss')"  # ß is SS or ẞ in capitals
ORACLES = {
    "q_quote_exact_contains": f"WITH {_QUOTES} SELECT quote_id, id FROM x",
    "q_quote_cascade": f"""WITH {_QUOTES}, z AS (SELECT *, min(rank) OVER (PARTITION BY quote_id) AS best FROM m),
w AS (SELECT quote_id, id, CASE rank WHEN 0 THEN 'exact' ELSE 'folded' END AS method, row_number() OVER (PARTITION BY quote_id ORDER BY id)::INTEGER AS no, count(*) OVER (PARTITION BY quote_id) AS total FROM z WHERE rank = best)
SELECT * FROM w WHERE no <= 5""",
    "q_same_words_run": f"""WITH {_QUOTES}, qw AS (SELECT quote_id, {_FOLD.format(_WORDS.format('quote'))} AS w FROM q), dw AS (SELECT id, {_FOLD.format(_WORDS.format('body'))} AS w FROM d)
SELECT quote_id, id FROM qw JOIN dw ON contains(dw.w, qw.w) WHERE qw.w <> '  '""",
    "q_keyword_score_topk": f"""
WITH a AS (SELECT item_id AS query_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM (SELECT item_id, {_TOKENS.format('text')} AS t FROM benchmark)),
f AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS no FROM a GROUP BY query_id, term),
q AS (SELECT query_id, list(term ORDER BY no) AS terms FROM f GROUP BY query_id),
b AS (SELECT conv_id * 1000 + turn AS id, {_TOKENS.format('text')} AS toks FROM conversations),
s AS (SELECT query_id, id, round(len(list_filter(terms, lambda t: CASE WHEN length(t) >= 4 THEN len(list_filter(toks, lambda w: starts_with(w, t))) > 0 ELSE list_contains(toks, t) END)) / len(terms), 6) AS score FROM q, b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 5""",
    "q_retrieval_search": with_views("""+
t AS (SELECT c.claim_id AS query_id, r.id, r.us, c.lo, c.hi, r.text = c.quote OR (r.text IS NOT NULL AND contains(r.text, c.quote)) AS kw,
  CASE WHEN (r.sender IS NOT NULL AND r.sender IN (c.a, c.b))::INT + (r.recipient IN (c.a, c.b) AND r.recipient IS DISTINCT FROM r.sender)::INT >= 2 THEN 2 ELSE 1 END AS tier
  FROM claims c JOIN records r ON r.sender IN (c.a, c.b) OR r.recipient IN (c.a, c.b)),
h AS (SELECT query_id, id, us, lo, hi, tier, CASE WHEN kw THEN 1.0 ELSE 0.0 END::DOUBLE AS share, coalesce(us BETWEEN lo AND hi, false) AS inside FROM t),
e AS (SELECT query_id, unnest([arg_max(id, (us, id)) FILTER (us < lo), arg_min(id, (us, id)) FILTER (us > hi)]) AS id FROM h WHERE us IS NOT NULL AND NOT inside GROUP BY query_id),
n AS (SELECT query_id, count(id) AS n_edges FROM e GROUP BY query_id),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, share DESC, us, id) AS rank FROM h WHERE inside)
SELECT m.query_id, id, tier, share, rank::INTEGER AS rank, false AS edge FROM m LEFT JOIN n ON n.query_id = m.query_id WHERE rank <= 10 - least(coalesce(n_edges, 0), 5)
UNION ALL SELECT e.query_id, e.id, tier, share, row_number() OVER (PARTITION BY e.query_id ORDER BY e.id)::INTEGER, true FROM e JOIN h ON h.query_id = e.query_id AND h.id = e.id"""),
    "q_text_folds": r"""
WITH t AS (SELECT conv_id, turn, '‘' || text || '’' AS t FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(translate(t, '‘’“”', '''''""'), '\s+', ' ', 'g')) AS quote_fold, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS space_fold,
  md5(trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g'))) AS alias_key, len(regexp_extract_all(lower(t), '([\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*)'))::BIGINT AS n_tokens FROM t""",
}
