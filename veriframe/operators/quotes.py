"""Quoted words in records: containment, cascades, word runs, keyword retrieval.

A quote is looked up by its rarest words: quotes and bodies meet by an equi-join on a few
anchor words of the quote, and only bodies that hold an anchor are searched. Neither side is
broadcast, so both may be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.text import case_fold, contains_aligned, quote_fold, term_matches, tokens, words_only
from veriframe.operators.timeline import window_edges
from veriframe.session import stored


def _anchor_words(text: Column) -> Column:
    """Runs of letters and digits in lower case, parted at apostrophes of any form: a word-aligned
    match holds all of the quote's, whole. The two small sigmas are one, as the letters beyond the
    match decide between them, and ß is ss, as in capitals."""
    return F.array_distinct(F.regexp_extract_all(case_fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _anchored(quotes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(quote_id, quote, id, body): bodies that hold the quote's rarest word."""
    words = bodies.select("id", F.explode(_anchor_words(F.col("body"))).alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    asked = quotes.select("quote_id", F.explode(_anchor_words(F.col("quote"))).alias("word"))
    rarest = asked.join(df, "word", "left").groupBy("quote_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    hits = rarest.join(words, "word").select("quote_id", "id")
    return hits.join(quotes, "quote_id").join(bodies, "id")


def find_quotes(quotes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(quote_id, id, method): word-aligned matches, ``exact`` or else ``folded`` (quote marks,
    spaces and case). Quotes without a word match nothing. quotes: quote_id, quote; bodies: id, body."""
    found = _anchored(quotes, bodies)
    fold = lambda c: case_fold(quote_fold(F.trim(c)))
    exact = contains_aligned(F.col("body"), F.col("quote"))
    folded = contains_aligned(fold(F.col("body")), fold(F.col("quote")))
    return found.select("quote_id", "id", F.when(exact, "exact").when(folded, "folded").alias("method")).filter("method IS NOT NULL")


def cascade(found: DataFrame, most: int = 25) -> DataFrame:
    """For each quote the matches of its strictest method, at most ``most`` shown, all counted."""
    rank = F.when(F.col("method") == "exact", 0).otherwise(1)
    w = Window.partitionBy("quote_id")
    best = found.withColumn("rank", rank).withColumn("best", F.min("rank").over(w)).filter("rank = best")
    shown = best.withColumn("total", F.count("*").over(w)).withColumn("no", F.row_number().over(w.orderBy("id")))
    return shown.filter(F.col("no") <= most).select("quote_id", "id", "method", "no", "total")


def same_words(quotes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(quote_id, id): the quote's words in a run, whatever stands between them."""
    found = _anchored(quotes, bodies)
    return found.filter(case_fold(words_only(F.col("body"))).contains(case_fold(words_only(F.col("quote"))))).select("quote_id", "id")


def messages_with(quotes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(quote_id, id): bodies that hold the quote word-aligned, as it stands but for the form of
    quote marks and the width of spaces."""
    held = contains_aligned(quote_fold(F.col("body")), quote_fold(F.trim("quote")))
    return _anchored(quotes, bodies).filter(held).select("quote_id", "id")


def keyword_score(queries: DataFrame, bodies: DataFrame, k: int) -> DataFrame:
    """The ``k`` bodies of each query that match most of its terms (share, 6 places half-even).

    queries: query_id, terms; bodies: id, body; a tie goes to the smaller id. A term of four letters
    or more begins a word: both meet by the first four. A shorter one is a whole word. Of a phrase
    the last word begins a word of the body; only bodies that hold that are searched for it.
    """
    asked = queries.select("query_id", F.size("terms").alias("n_terms"), F.posexplode(F.transform("terms", lambda t: F.lower(t))).alias("no", "term"))
    words = bodies.select("id", F.explode(F.array_distinct(tokens(F.col("body")))).alias("word"))
    keys = ["query_id", "no", "n_terms", "id"]
    phrase, long = F.instr("term", " ") > 0, F.length("term") >= 4
    head = lambda c, n=4: F.left(F.col(c), F.lit(n))
    whole = asked.filter(~phrase & ~long).join(words, F.col("term") == F.col("word")).select(*keys)
    begun = asked.filter(~phrase & long).withColumn("head", head("term")).join(words.filter(F.length("word") >= 4).withColumn("head", head("word")), "head")
    begun = begun.filter(F.col("word").startswith(F.col("term"))).select(*keys)
    last = F.left(F.element_at(tokens(F.col("term")), -1), F.lit(4))
    phrases = asked.filter(phrase).withColumn("head", last).filter("head IS NOT NULL")
    heads = words.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length("word"))), lambda n: F.left("word", n)))).alias("head")).distinct()
    met = phrases.join(heads, "head").join(bodies, "id")
    met = met.filter(F.lower("body").contains(F.col("term"))).select(*keys)
    found = whole.unionByName(begun).unionByName(met).groupBy("query_id", "id", "n_terms").agg(F.count_distinct("no").alias("n"))
    scored = found.select("query_id", "id", F.bround(F.col("n") / F.col("n_terms"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def retrieve(queries: DataFrame, records: DataFrame, k: int, edge_share: int = 2) -> DataFrame:
    """The records of each query in rank order: tier (accounts of two sides, or of one), share of
    terms, untimed last, time, id. The nearest record before and after the window keep seats of their own.

    queries: query_id, sides (arrays of accounts), terms, lo, hi. records: id, sender, recipients,
    us, text. Two sides are touched only by two different accounts.

    What several queries ask (an account, or two of different sides, with the same terms and window)
    is asked once, and only the first ``k`` of its records go on to them: a record that touches two
    sides ranks before all of one, so these hold the first ``k`` of each query. The nearest outside
    a window are found in sorted passes of an account's time buckets.
    """
    parties = F.array_compact(F.array_distinct(F.concat(F.array("sender"), "recipients")))
    folded = F.lower(F.coalesce("text", F.lit("")))
    held = records.select("id", "us", parties.alias("parties"), folded.alias("folded"), tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    by_account = held.filter("us IS NOT NULL").select(F.explode("parties").alias("account"), "*")
    df = by_account.groupBy("account").agg(F.count("*").alias("df"))
    sided = queries.select("query_id", F.posexplode("sides").alias("side", "accounts")).select("query_id", "side", F.explode(F.array_distinct("accounts")).alias("account")).filter("account IS NOT NULL")
    one = sided.select("query_id", "account").distinct()
    # of two accounts the one of fewer records is looked up
    counted = sided.join(df, "account").select("query_id", "side", F.struct("df", "account").alias("x"))
    two = counted.join(counted.select("query_id", F.col("side").alias("side2"), F.col("x").alias("y")), "query_id").filter("side <> side2 AND x < y")
    both = two.select("query_id", F.col("x.account").alias("account"), F.col("y.account").alias("other")).distinct()
    asking = one.withColumn("other", F.lit(None).cast(one.schema["account"].dataType)).unionByName(both).join(queries.select("query_id", "terms", "lo", "hi"), "query_id")
    what = ["account", "other", "terms", "lo", "hi"]
    asking = asking.withColumn("key", F.to_json(F.struct(*what)))  # equal where all are, nulls too
    asks = stored(asking.select("key", *what).dropDuplicates(["key"]).withColumn("ask_id", F.monotonically_increasing_id()))
    mine = asking.select("query_id", "key", F.when(F.col("other").isNull(), 1).otherwise(2).alias("tier")).join(asks.select("key", "ask_id"), "key").drop("key")

    share = F.bround(F.size(F.filter("terms", lambda t: term_matches(F.lower(t), F.col("toks"), F.col("folded")))) / F.greatest(F.size("terms"), F.lit(1)), 6)
    met = asks.join(by_account, "account").filter("us BETWEEN lo AND hi").filter(F.col("other").isNull() | F.array_contains("parties", F.col("other")))
    met = met.select("ask_id", "id", "us", share.alias("share"))
    best = met.withColumn("no", F.row_number().over(Window.partitionBy("ask_id").orderBy(F.desc("share"), "us", "id"))).filter(F.col("no") <= k).drop("no")
    rows = mine.join(best, "ask_id").groupBy("query_id", "id").agg(F.max("tier").alias("tier"), F.max("share").alias("share"), F.max("us").alias("us"))
    q = Window.partitionBy("query_id")
    main = rows.withColumn("rank", F.row_number().over(q.orderBy(F.desc("tier"), F.desc("share"), "us", "id")))

    far = 1 << 62  # an open end has nothing beyond it
    windows = asks.filter("other IS NULL").select(F.col("ask_id").alias("window_id"), "account", F.coalesce("lo", F.lit(-far)).alias("lo"), F.coalesce("hi", F.lit(far)).alias("hi"))
    sides = window_edges(windows, by_account.select("account", "us", "id"), ["account"]).withColumnRenamed("window_id", "ask_id")
    edges = mine.join(sides, "ask_id").groupBy("query_id").agg(
        F.max(F.when(F.col("before_us").isNotNull(), F.struct("before_us", "before_id"))).alias("before"), F.min(F.when(F.col("after_us").isNotNull(), F.struct("after_us", "after_id"))).alias("after")
    ).select("query_id", F.explode(F.array_compact(F.array("before.before_id", "after.after_id"))).alias("id"))
    seats = edges.groupBy("query_id").agg(F.count("*").alias("n_edges"))
    main = main.join(seats, "query_id", "left").withColumn("budget", F.lit(k) - F.least(F.coalesce("n_edges", F.lit(0)), F.lit(k // edge_share)))
    kept = main.filter(F.col("rank") <= F.col("budget")).select("query_id", "id", "tier", "share", F.col("rank").cast("int").alias("rank"), F.lit(False).alias("edge"))
    touched = F.size(F.array_intersect(F.array_distinct(F.flatten("sides")), F.col("parties")))
    n_sides = F.size(F.filter("sides", lambda s: F.arrays_overlap(s, F.col("parties"))))
    ends = edges.join(held, "id").join(queries, "query_id").select("query_id", "id", F.when((n_sides >= 2) & (touched >= 2), 2).otherwise(1).alias("tier"), share.alias("share"))
    ends = ends.select("query_id", "id", "tier", "share", F.row_number().over(q.orderBy("id")).alias("rank"), F.lit(True).alias("edge")).filter(F.col("rank") <= k // edge_share)
    return kept.unionByName(ends)


def self_introductions(records: DataFrame, text: Column) -> DataFrame:
    """Records in which a sender names themselves: (id, name)."""
    name = F.regexp_extract(text, r"(?i)\b(?:my name is|this is|i am|i'm)\s+(\p{L}+)", 1)
    return records.select("id", name.alias("name")).filter("name <> ''")
