"""Evidence around a claim: terms, candidates in rank order, digests, and how times and texts read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.predicates import never_null
from veriframe.functions.text import contains_aligned, quote_fold, quoted, tokens
from veriframe.operators.integrity import json_digest
from veriframe.operators.timeline import natural_key, nearest

DAY = 86_400_000_000
SHEETS = 1_000_000  # headers that one task may hold
# Words of a document's title or opening that tell its kind, in this order.
DOCUMENT_KINDS = (
    ("affidavit", ("AFFIDAVIT", "SWORN STATEMENT")),
    ("forensic_report", ("FORENSIC", "EXTRACTION REPORT", "EXAMINATION REPORT")),
    ("police_report", ("INCIDENT REPORT", "POLICE", "OFFENSE REPORT", "ARREST REPORT")),
)


def document_kind(title: Column, opening: Column) -> Column:
    """The kind whose words the title holds, else the opening; other if neither holds any."""
    holds = lambda text, words: never_null(F.upper(text).rlike("|".join(words)))
    out = None
    for text in (title, opening):
        for kind, words in DOCUMENT_KINDS:
            out = F.when(holds(text, words), kind) if out is None else out.when(holds(text, words), kind)
    return out.otherwise("other")


def local_time(us: Column, zone: Column, raw: Column) -> Column:
    """An instant on a device's own clock with its offset; in UTC, and saying so, where the zone is
    unknown; what the source shows where the time is."""
    at = F.timestamp_micros(us)
    local = F.from_utc_timestamp(at, zone)
    minutes = F.round((F.unix_micros(local) - us) / 60_000_000).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.format_string("(UTC%s%02d:%02d)", sign, F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    shown = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    unknown = F.when(raw.isNull(), "time unknown").otherwise(F.concat(F.lit("time unknown (source shows '"), raw, F.lit("')")))
    return F.when(us.isNull(), unknown).when(zone.isNull(), F.concat(shown(at), F.lit(" UTC (device zone unknown)"))).otherwise(F.concat_ws(" ", shown(local), offset))


def excerpts(texts: DataFrame, blocks: bool = False) -> DataFrame:
    """(id, no, start, end, excerpt): the quoted messages of an exhibit: its lines, or what stands
    between blank lines, trimmed; parts without a letter or digit are skipped. Offsets are code
    points of the text, the end outside."""
    mark = "\x1d"
    cut = F.regexp_replace("text", r"\n[\x20\x09\x0B-\x0D]*(?:\n[\x20\x09\x0B-\x0D]*)*\n", "\n" + mark) if blocks else F.replace("text", F.lit("\n"), F.lit("\n" + mark))
    # the marks keep every character but the blanks of a separator, whose length is kept beside
    parts = texts.select("id", "text", F.posexplode(F.split(cut, mark)).alias("part", "piece"))
    if blocks:
        gaps = texts.select("id", F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(r"(\n[\x20\x09\x0B-\x0D]*(?:\n[\x20\x09\x0B-\x0D]*)*\n)"), F.lit(1)), lambda g: F.length(g) - 1)).alias("part", "more"))
        parts = parts.join(gaps, ["id", "part"], "left")
    else:
        parts = parts.withColumn("more", F.lit(0))
    w = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece") + F.coalesce("more", F.lit(0))).over(w), F.lit(0))
    lead = F.length("piece") - F.length(F.regexp_replace("piece", r"^\s+", ""))
    bare = F.regexp_replace("piece", r"^\s+|\s+$", "")
    found = parts.withColumn("start", at + lead).withColumn("excerpt", bare).filter(F.col("excerpt").rlike(r"[\p{L}\p{N}]"))
    no = F.row_number().over(Window.partitionBy("id").orderBy("part"))
    return found.select("id", no.alias("no"), F.col("start").cast("int").alias("start"), (F.col("start") + F.length("excerpt")).cast("int").alias("end"), "excerpt")


def sentences(text: Column) -> Column:
    """The sentences of a text. A stop after a title, an initial, or in a.m. and p.m. ends none."""
    held = F.regexp_replace(text, r"(?i)(?<![\p{L}\p{N}_])(Mr|Mrs|Ms|Dr|No|St|Jr|Sr|Inc|Co|Ave|approx|[ap]\.\s?m|[A-Z])\.(?=\s)", "$1\x1d")
    ended = F.regexp_replace(held, r"([.!?][\"”]?)\s+(?=[\"“(]?[A-Z0-9])", "$1\x1e")
    return F.filter(F.transform(F.split(ended, "\x1e"), lambda s: F.replace(s, F.lit("\x1d"), F.lit("."))), lambda s: F.trim(s) != "")


def one_message_stance(stance: Column, quote: Column, text: Column, near: Column) -> Column:
    """What a label says of an assumption about one quoted message. Another record can neither
    contradict nor support it: the first is kept as complicating, the second too if its words come
    ``near`` the quote, else it is irrelevant."""
    is_it = contains_aligned(text, quote)
    reads_it = contains_aligned(quote_fold(text), quote_fold(quote))
    said = F.when((stance == "contradicts") & ~is_it, "complicates").when((stance == "supports") & ~reads_it, F.when(near, "complicates").otherwise("irrelevant")).otherwise(stance)
    return F.when(F.coalesce(quote, F.lit("")) == "", stance).otherwise(said)


def search_terms(text: Column, stop: tuple[str, ...]) -> Column:
    """``handles``, ``numbers`` and ``keywords`` of a wording: @names as written; digits of telephone
    numbers of seven or more and bare ids of five or more; quoted phrases, then words of three letters
    or more that are no stop words, in the order they are first seen."""
    handle = r"(?<![\p{L}\p{N}_@])@[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*"
    phone = r"(?<![\p{L}\p{N}_])\+?[0-9][0-9\s().-]{5,}[0-9](?![\p{L}\p{N}_])"
    rest = F.regexp_replace(text, handle, " ")
    bare = F.regexp_replace(rest, phone, " ")
    phones = F.filter(F.transform(F.regexp_extract_all(rest, F.lit(phone), F.lit(0)), lambda m: F.regexp_replace(m, "[^0-9]", "")), lambda d: F.length(d) >= 7)
    ids = F.filter(F.regexp_extract_all(bare, F.lit(r"[0-9]+"), F.lit(0)), lambda d: F.length(d) >= 5)
    phrases = F.filter(F.transform(quoted(bare), lambda p: F.trim(F.lower(p))), lambda p: F.instr(p, " ") > 0)
    words = F.transform(tokens(bare), lambda w: F.regexp_replace(w, "['’]s$", ""))
    words = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop) & ~w.rlike("^[0-9]+$"))
    return F.struct(F.array_distinct(F.regexp_extract_all(text, F.lit(handle), F.lit(0))).alias("handles"), F.array_distinct(F.concat(phones, ids)).alias("numbers"), F.array_distinct(F.concat(phrases, words)).alias("keywords"))


# -------------------------------------------------------------------- candidates
def score(tier: Column, share: Column, has_party: Column, has_sides: Column) -> Column:
    """A candidate's score: half for its party, a quarter each for joining two sides and for the share
    of terms; without sides the terms count half, without a party they are all."""
    return F.when(~has_party, F.bround(share, 6)).when(has_sides, F.bround(0.5 + F.when(tier >= 2, 0.25).otherwise(0.0) + 0.25 * share, 6)).otherwise(F.bround(0.5 + 0.5 * share, 6))


def rank_order() -> list[Column]:
    """Higher tier, larger share, contacts before other records, untimed last, time, id."""
    return [F.desc("tier"), F.desc("share"), (F.col("kind") != "contact"), F.col("us").isNull(), F.col("us"), F.col("id")]


def quote_edges(outside: DataFrame, most: int = 4, reach_us: int = DAY) -> DataFrame:
    """(query_id, id, no): of the records outside a window that hold its quote, those closest to its
    edges, at most ``most`` and within ``reach_us``. outside: query_id, id, us, lo, hi, quote_hit."""
    gap = F.when(F.col("us") < F.col("lo"), F.col("lo") - F.col("us")).otherwise(F.coalesce(F.col("us") - F.col("hi"), F.lit(0)))
    near = outside.filter("us IS NOT NULL AND quote_hit").withColumn("gap", gap).filter(F.col("gap") <= reach_us)
    return near.withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "id"))).filter(F.col("no") <= most).select("query_id", "id", "no")


def nearest_edges(windows: DataFrame, records: DataFrame, key: str, most: int = 4, reach_us: int = DAY) -> DataFrame:
    """(query_id, id, no): as ``quote_edges`` of all records of a window's key outside it, which do not
    meet: an edge asks once for all windows that have it for the nearest beyond it (``timeline.nearest``).
    windows: query_id, key, lo, hi, these not null; records: id, key, us."""
    far = []
    for edge, sign, past in (("lo", -1, 0), ("hi", 1, 1)):  # the instant of an end is inside
        asked = windows.select(key, edge).dropna().distinct().select(F.struct(key, edge).alias("ask_id"), key, (F.col(edge) + past).alias("us"))
        near = nearest(asked, records.select("id", key, "us"), [key], most, reach_us - past, sides=(sign,))
        near = near.select(F.col(f"ask_id.{key}").alias(key), F.col(f"ask_id.{edge}").alias(edge), "id", (F.col("gap_us") + past).alias("gap_us"))
        far.append(windows.join(near, [key, edge]).select("query_id", "id", "gap_us"))
    placed = far[0].unionByName(far[1]).withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy("gap_us", "id")))
    return placed.filter(F.col("no") <= most).select("query_id", "id", "no")


def with_companions(ranked: DataFrame, companions: DataFrame, k: int, edges: DataFrame | None = None) -> DataFrame:
    """(query_id, id, place): up to ``k`` records of each query, taken in turn: a record that is not
    taken yet is followed by those that come with it; one that came with another brings none. The
    records at the edges of a window (``edges``) keep as many seats as there are of them, up to half.

    ranked, edges: query_id, id, rank; companions: id, with_id, no (from 1). Every turn takes at least
    its own record, so only the first ``k`` ranks, edges and companions can matter: a query's turns
    are one bounded array, folded in the row."""
    first = lambda rows, by, order: rows.withColumn("__no", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__no") <= k)
    more = first(companions, ["id"], ["no", "with_id"]).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "with_id"))), lambda c: c.with_id).alias("more"))

    def turns(rows: DataFrame, out: str) -> DataFrame:
        with_more = first(rows.select("query_id", "id", "rank"), ["query_id"], ["rank", "id"]).join(more, "id", "left")
        turn = F.concat(F.array("id"), F.coalesce("more", F.array().cast(rows.select(F.array("id")).schema[0].dataType)))
        return with_more.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", turn.alias("turn")))), lambda t: t.turn).alias(out))

    kind = ranked.select(F.array(F.array("id"))).schema[0].dataType
    none = F.array().cast(kind)
    all_ = turns(ranked, "inside")
    all_ = all_.join(turns(edges, "edges"), "query_id", "full") if edges is not None else all_.withColumn("edges", none)
    all_ = all_.select("query_id", F.coalesce("inside", none).alias("inside"), F.coalesce("edges", none).alias("edges"))
    take = lambda most: lambda taken, turn: F.when(F.array_contains(taken, F.element_at(turn, 1)), taken).otherwise(F.slice(F.array_union(taken, turn), F.lit(1), most))
    budget = F.lit(k) - F.least(F.size("edges"), F.lit(k // 2))
    main = F.aggregate("inside", F.array().cast(kind.elementType), take(budget))
    taken = all_.select("query_id", "edges", main.alias("taken")).select("query_id", F.aggregate("edges", F.col("taken"), take(F.lit(k))).alias("taken"))
    return taken.select("query_id", F.posexplode("taken").alias("place", "id")).select("query_id", "id", (F.col("place") + 1).alias("place"))


def attachments_of(hits: DataFrame, attachments: DataFrame) -> DataFrame:
    """(id, attachment_id, file_name): the attachments of each record, in order of their ids; a record
    without any keeps its row."""
    return hits.select("id").distinct().join(attachments.select(F.col("message_id").alias("id"), F.col("id").alias("attachment_id"), "file_name"), "id", "left")


def groups_near(near: DataFrame, anchor_threads: DataFrame) -> DataFrame:
    """(claim_id, thread_id, n, has_anchor, gap_us, place): the records near a claim by conversation:
    calls (no thread) last, conversations that hold a record of the claim first, then the closest,
    then in natural order. near: claim_id, thread_id, id, gap_us; anchor_threads: claim_id, thread_id."""
    g = near.groupBy("claim_id", "thread_id").agg(F.count("*").alias("n"), F.min("gap_us").alias("gap_us"))
    g = g.join(anchor_threads.distinct().withColumn("has_anchor", F.lit(True)), ["claim_id", "thread_id"], "left").withColumn("has_anchor", F.coalesce("has_anchor", F.lit(False)))
    order = [F.col("thread_id").isNull(), ~F.col("has_anchor"), F.col("gap_us"), natural_key(F.coalesce("thread_id", F.lit("")))]
    return g.withColumn("place", F.row_number().over(Window.partitionBy("claim_id").orderBy(*order)))


def shown_gaps(shown: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a passage with the seconds since the row shown before; null where either has no time."""
    return shown.withColumn("gap_s", F.floor((F.col("us") - F.lag("us").over(Window.partitionBy(*by).orderBy("pos"))) / 1_000_000))


# ----------------------------------------------------------------------- digests
def item_digests(items: DataFrame, reviews: DataFrame, records: DataFrame, runs: DataFrame, fields: list[str]) -> DataFrame:
    """(item, digest): SHA-256 over an item's own fields, its reviews by the AI in order, the record it
    cites and the model runs that it and those reviews name.

    items: item, record_id, model_run and ``fields``; reviews: item, seq, kind, status, model_run;
    records: id, text; runs: model_run, model. Reviews and runs of an item are few and are folded
    by their digests, in order."""
    by_ai = reviews.filter("kind = 'ai'")
    order = lambda rows: F.transform(F.array_sort(rows), lambda r: r.h)
    folded = by_ai.groupBy("item").agg(F.array_join(order(F.collect_list(F.struct("seq", json_digest(F.col("status"), F.col("model_run")).alias("h")))), "").alias("reviews"))
    named = items.select("item", "model_run").unionByName(by_ai.select("item", "model_run")).filter("model_run IS NOT NULL").distinct().join(runs, "model_run")
    named = named.groupBy("item").agg(F.array_join(order(F.collect_list(F.struct("model_run", json_digest(F.col("model_run"), F.col("model")).alias("h")))), "").alias("runs"))
    cited = records.select(F.col("id").alias("record_id"), json_digest(F.col("id"), F.col("text")).alias("record"))
    j = items.join(folded, "item", "left").join(named, "item", "left").join(cited, "record_id", "left")
    return j.select("item", json_digest(*[F.col(f) for f in fields], F.col("reviews"), F.col("record"), F.col("runs")).alias("digest"))


def group_digest(digests: DataFrame, by: str) -> DataFrame:
    """(by, n, digest): SHA-256 over the sorted digests of a group: of the items of a claim, or of the
    calls of a run. A group of any size is folded by ``integrity.rows_digest``."""
    from veriframe.operators.integrity import rows_digest

    return rows_digest(digests, by, ["digest"])


# -------------------------------------------------------------------- evaluation
def evaluation(scored: DataFrame, positive: str) -> DataFrame:
    """One row: n, correct, accuracy, and of the predictions of ``positive`` how many are false."""
    said, true = F.col("predicted") == positive, F.col("gold") == positive
    t = scored.agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("correct"), F.count_if(said & ~true).alias("false_positive"), F.count_if(~true).alias("n_negative"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 9))
    return t.withColumns({"accuracy": rate("correct", "n"), "false_rate": rate("false_positive", "n_negative")})


def header_fields(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(sheet, field, col_no): the column of each known field, by name and never by place; the first of
    several. headers: sheet, cells; aliases: alias, field."""
    cells = headers.select("sheet", F.posexplode("cells").alias("col_no", "cell"))
    keyed = cells.withColumn("alias", F.regexp_replace(F.lower(F.trim("cell")), r"\s+", " "))
    # dealt by sheet before anything is kept: a task holds the sheets of its part, not of its whole input
    parts = headers.count() // SHEETS + 1
    return keyed.join(aliases, "alias").select("sheet", "field", "col_no").repartition(parts, "sheet").groupBy("sheet", "field").agg(F.min("col_no").alias("col_no"))


# Reasons that an import lists for attention; others are for information.
ATTENTION = ("bad_date", "undecided_order", "unreadable", "no_offset")


def coverage_items(counts: DataFrame) -> DataFrame:
    """(sheet, reason, n, level): what an import did not read as it stands, for attention or information."""
    level = F.when(F.col("reason") == "read", None).when(F.col("reason").isin(*ATTENTION), "attention").otherwise("info")
    return counts.withColumn("level", level).filter("level IS NOT NULL")
