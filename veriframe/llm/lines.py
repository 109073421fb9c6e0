"""Line dedup (7): exact and near copies of lines, by a segment-partition edit join.

Lines are what stands between line feeds, without blanks at their ends. A line that holds more
than blanks goes if an equal line stands earlier; a line of at least ``MIN_CHARS`` code points
also goes if a line one edit away (insertion, deletion or substitution of one code point) stands
earlier. Documents are ordered by id, lines by their place. Lines are judged on the input, not on
what is left. Everything is a DataFrame expression: no user function and no Python code runs on
the executors.

1. Equal lines meet by a 128-bit hash; the first place of each is a minimum by key.
2. With one edit allowed, a line is split into two segments, one of which must be whole in any
   match. Each distinct line files its two halves under its own length, and probes the lines
   that are one shorter with the substrings that can face their halves (``_segments``).
3. Segments that few lines share give candidate pairs. Segments that more than ``CROWD`` lines
   share are split further: the part outside the segment, where the edit must be, is cut into
   eight, and lines meet again only if all but one of the eight agree. This is repeated until
   the groups are small or one character is left, where a star to the earliest line and a join
   on that character take the place of all pairs. So no group is ever paired within itself.
4. Pairs are verified by bit-parallel edit distance on what differs between their common
   beginning and their common end (the band; more than ``BAND`` characters exceed the limit).

Null and empty texts have no lines to remove and stay as they are. Different texts under one id
are documents of their own, ordered by a hash of the text, of which 128 bits tell them apart; rows
equal in id and text are judged alike, as one document. A null id is ordered after all others, and
is another key than the largest id. Extra columns are kept by
``dedup`` and not read; the names it adds are ``n_lines`` and ``n_removed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut, let, shared_dir, text_of

#: The threshold is one edit; the segments (two), the probes (one length up) and the splitting of
#: crowded segments (one hole) are made for it.
MIN_CHARS, CROWD, PARTS, BAND = 20, 24, 8, 8

_LAST = (1 << 63) - 1
_BLANKS = " \t\x0b\x0c\r"

#: A text: whether it has no id, its id, and 128 bits of a hash that tell the texts of one id (or of
#: none) apart. In this order texts are ordered; a line's number comes after them.
TEXT = ("no_id", "doc", "text_1", "text_2")
PLACE = (*TEXT, "line_no")


def _text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(2), text)


def _text_key(id_col: str, text_col: str) -> dict[str, Column]:
    doc = F.col(id_col).cast("long")
    return dict(zip(TEXT, (doc.isNull(), F.coalesce(doc, F.lit(_LAST)), *_text_hashes(text_of(text_col)))))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The key of each text, and the text."""
    key = _text_key(id_col, text_col)
    return docs.select(*[c.alias(name) for name, c in key.items()], text_of(text_col).alias("text"))


def _occurrences(source: DataFrame) -> DataFrame:
    """(``PLACE``, line, size) of the lines that hold more than blanks."""
    rows = source.select(*TEXT, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(_BLANKS)))
    return rows.withColumn("size", F.length("line")).filter(F.col("size") > 0)


def _keys() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


def _segments(min_chars: int) -> list[Column]:
    """Hashes of the halves of a line of ``min_chars`` or more, filed under its length (s) and facing
    the halves of lines one shorter (l); 0 is the first half, 1 the second."""
    s, n = F.col("line"), F.col("size")
    enough = lambda c: F.when(n >= min_chars, c)
    half, half_short = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    part = lambda a, b: F.substring(s, a + 1, b - a)
    long = lambda c: F.when(n > min_chars, c)
    return [
        enough(F.xxhash64(n, F.lit(0), part(F.lit(0), half))).alias("s0"),
        enough(F.xxhash64(n, F.lit(1), part(half, n))).alias("s1"),
        long(F.xxhash64(n - 1, F.lit(0), part(F.lit(0), half_short))).alias("l0"),
        long(F.xxhash64(n - 1, F.lit(1), part(half_short + 1, n))).alias("l1"),
    ]


def _common(a: Column, b: Column, end: bool) -> Column:
    """Length of the common beginning (or end) of two strings, by halving steps."""
    side = F.right if end else F.left
    most = F.least(F.length(a), F.length(b))
    highest = F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int")
    steps = F.transform(F.sequence(highest, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(
        steps, F.lit(0), lambda p, s: F.when((p + s <= most) & (side(a, p + s) == side(b, p + s)), p + s).otherwise(p)
    )


def _bit_parallel(a: Column, b: Column) -> Column:
    """Levenshtein distance of two strings of at most 60 characters: one machine word holds a
    column of the table as differences of neighbours (+1 in vp, -1 in vn)."""
    n = F.length(a)
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    top = F.call_function("shiftleft", F.lit(1).cast("long"), n - 1)
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    zero = F.lit(0).cast("long")
    start = F.struct(ones.alias("vp"), zero.alias("vn"), n.cast("long").alias("d"))

    def step(state: Column, c: Column) -> Column:
        places = F.transform(chars(a), lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero))
        eq = F.aggregate(places, zero, lambda x, y: x.bitwiseOR(y))
        return let(
            F.struct(eq.alias("eq"), state.vp.alias("vp"), state.vn.alias("vn"), state.d.alias("d")),
            lambda t: let(
                F.struct(
                    ((t.eq.bitwiseAND(t.vp) + t.vp).bitwiseXOR(t.vp)).bitwiseOR(t.eq).bitwiseOR(t.vn).bitwiseAND(ones).alias("d0"),
                    t.vp.alias("vp"), t.vn.alias("vn"), t.d.alias("d"),
                ),
                lambda u: let(
                    F.struct(
                        u.vn.bitwiseOR(F.bitwise_not(u.d0.bitwiseOR(u.vp))).bitwiseAND(ones).alias("hp"),
                        u.d0.bitwiseAND(u.vp).alias("hn"), u.d0.alias("d0"), u.d.alias("d"),
                    ),
                    lambda v: let(
                        F.struct(
                            (v.hp * 2 + 1).bitwiseAND(ones).alias("hp"), (v.hn * 2).bitwiseAND(ones).alias("hn"), v.d0.alias("d0"),
                            (v.d + (v.hp.bitwiseAND(top) != 0).cast("long") - (v.hn.bitwiseAND(top) != 0).cast("long")).alias("d"),
                        ),
                        lambda w: F.struct(
                            w.hn.bitwiseOR(F.bitwise_not(w.d0.bitwiseOR(w.hp))).bitwiseAND(ones).alias("vp"),
                            w.hp.bitwiseAND(w.d0).alias("vn"), w.d.alias("d"),
                        ),
                    ),
                ),
            ),
        )

    return F.when(n == 0, F.length(b).cast("long")).otherwise(F.aggregate(chars(b), start, step, lambda s: s.d))


def within(a: Column, b: Column) -> Column:
    """Whether two strings are at most one edit apart."""
    same = F.struct(a.alias("a"), b.alias("b"), _common(a, b, False).alias("p"))

    def cores(t: Column) -> Column:
        rest_a, rest_b = F.substring(t.a, t.p + 1, F.length(t.a)), F.substring(t.b, t.p + 1, F.length(t.b))
        return let(
            F.struct(rest_a.alias("a"), rest_b.alias("b"), _common(rest_a, rest_b, True).alias("q")),
            lambda r: let(
                F.struct(F.left(r.a, F.length(r.a) - r.q).alias("a"), F.left(r.b, F.length(r.b) - r.q).alias("b")),
                lambda c: F.when(F.greatest(F.length(c.a), F.length(c.b)) > BAND, F.lit(False)).otherwise(_bit_parallel(c.a, c.b) <= 1),
            ),
        )

    return F.when(F.abs(F.length(a) - F.length(b)) > 1, F.lit(False)).otherwise(let(same, cores))


def _pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs (later, earlier) of lines that share a segment, of a small group.

    Only pairs whose hole agrees in its left or in its right part too are kept: the one edit
    cannot be in both.
    """
    a = rows.filter("role = 's'").select("key", *[F.col(c).alias(f"{c}_a") for c in ("id", "first", "line", "lo", "hi")])
    b = rows.select("key", *[F.col(c).alias(f"{c}_b") for c in ("id", "first", "line", "lo", "hi", "role")])
    both = a.join(b, "key").filter("id_a <> id_b AND (role_b = 'l' OR first_a < first_b)")
    mid_a, mid_b = [F.floor((F.col(f"lo_{x}") + F.col("hi_a")) / 2).cast("int") for x in "ab"]
    left = F.substring("line_a", F.col("lo_a") + 1, mid_a - F.col("lo_a")) == F.substring("line_b", F.col("lo_b") + 1, mid_b - F.col("lo_b"))
    right = F.substring("line_a", mid_a + 1, F.col("hi_a") - mid_a) == F.substring("line_b", mid_b + 1 + F.col("hi_b") - F.col("hi_a"), F.col("hi_a") - mid_a)
    return _oriented(both.filter(left | right))


def _oriented(pairs: DataFrame) -> DataFrame:
    late = F.col("first_a") > F.col("first_b")
    return pairs.select(
        F.when(late, F.col("id_a")).otherwise(F.col("id_b")).alias("id"),
        F.when(late, F.col("line_a")).otherwise(F.col("line_b")).alias("late"),
        F.when(late, F.col("line_b")).otherwise(F.col("line_a")).alias("early"),
    )


def _split(rows: DataFrame) -> DataFrame:
    """Each row again for each part of its hole, with the key of all other parts."""
    lo, hi = F.col("lo"), F.col("hi")
    extra = F.when(F.col("role") == "l", 1).otherwise(0)
    size = hi - lo - extra  # of the hole in the shorter line
    n = F.least(F.lit(PARTS), size)
    bound = lambda i: (lo + F.floor(i * size / n)).cast("int")
    holes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), bound(i).alias("lo"), (bound(i + 1) + extra).alias("hi")))
    rows = rows.select("key", "id", "first", "line", "role", lo.alias("from"), hi.alias("to"), F.explode(holes).alias("hole"))
    outside = F.xxhash64(
        "key", "hole.i",
        F.substring("line", F.col("from") + 1, F.col("hole.lo") - F.col("from")),
        F.substring("line", F.col("hole.hi") + 1, F.col("to") - F.col("hole.hi")),
    )
    return rows.select(outside.alias("key"), "id", "first", "line", "role", "hole.lo", "hole.hi")


def _leaves(rows: DataFrame) -> DataFrame:
    """Pairs of large groups whose hole is one character: stars, and a join on that character."""
    short = rows.filter("role = 's'")
    centre = short.groupBy("key").agg(F.min_by(F.struct("id", "first", "line"), "first").alias("c"))
    star = short.join(centre, "key").filter("id <> c.id").select(
        F.col("id").alias("id_a"), F.col("first").alias("first_a"), F.col("line").alias("line_a"),
        F.col("c.id").alias("id_b"), F.col("c.first").alias("first_b"), F.col("c.line").alias("line_b"),
    )
    one = short.select("key", F.substring("line", F.col("lo") + 1, F.lit(1)).alias("c"), F.col("id").alias("id_a"), F.col("first").alias("first_a"), F.col("line").alias("line_a"))
    two = rows.filter("role = 'l'").select(
        "key", F.explode(F.array_distinct(F.array(F.substring("line", F.col("lo") + 1, F.lit(1)), F.substring("line", F.col("lo") + 2, F.lit(1))))).alias("c"),
        F.col("id").alias("id_b"), F.col("first").alias("first_b"), F.col("line").alias("line_b"),
    )
    # a long line that precedes the short one removes it; only the earliest of them is needed
    facing = one.join(two, ["key", "c"])
    first_long = facing.groupBy("id_a", "key", "c").agg(F.min_by(F.struct("id_b", "first_b", "line_b"), "first_b").alias("e"), F.any_value("first_a").alias("first_a"), F.any_value("line_a").alias("line_a"))
    back = first_long.select("id_a", "first_a", "line_a", "e.*").filter("first_b < first_a")
    return _oriented(star.unionByName(facing.filter("first_a < first_b").select(*star.columns)).unionByName(back.select(*star.columns)))


def near_lines(distinct: DataFrame, source: DataFrame, path: str) -> DataFrame:
    """(h1, h2) of distinct lines with an earlier line within one edit.

    ``distinct``: h1, h2, first (its place) and the hashes of ``_segments``.
    """
    spark = source.sparkSession
    filed = distinct.select(
        "h1", "h2",
        F.explode(F.array(*[F.struct(F.col(c).alias("key"), F.lit(c[0]).alias("role"), F.lit(int(c[1])).alias("half")) for c in ("s0", "s1", "l0", "l1")])).alias("e"),
    ).select("h1", "h2", "e.*").filter("key IS NOT NULL")
    shared = filed.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "s").alias("n_short")).filter("n > 1 AND n_short > 0")
    filed.join(shared.drop("n_short"), "key").write.parquet(f"{path}/filed")
    filed = spark.read.parquet(f"{path}/filed")
    # each wanted line is read where it first stands: that key is no hot one, unlike the line itself;
    # lines go to their keys at every size, so that a large input runs by the plan a small one does
    wanted = distinct.select("h1", "h2", "first").join(filed.select("h1", "h2").distinct().hint("merge"), ["h1", "h2"])
    wanted = wanted.select("h1", "h2", "first.*")
    lines = _occurrences(source).select(*PLACE, "line").join(wanted.hint("merge"), list(PLACE))
    lines = lines.select("h1", "h2", F.struct(*PLACE).alias("first"), "line")
    lines.dropDuplicates(["h1", "h2"]).write.parquet(f"{path}/lines")
    size = F.length("line")
    half = F.floor((size - F.when(F.col("role") == "l", 1).otherwise(0)) / 2).cast("int")
    rows = filed.join(spark.read.parquet(f"{path}/lines"), ["h1", "h2"]).select(
        "key", "n", F.struct("h1", "h2").alias("id"), "first", "line", "role",
        F.when(F.col("half") == 0, half).otherwise(0).alias("lo"),  # the hole: the half that may differ
        F.when(F.col("half") == 0, size).otherwise(half + F.when(F.col("role") == "l", 1).otherwise(0)).alias("hi"),
    )
    pairs = _pairs(rows.filter(F.col("n") <= CROWD).drop("n"))
    crowded = cut(rows.filter(F.col("n") > CROWD).drop("n"))
    while not crowded.isEmpty():
        rows = _split(crowded)
        count = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "s").alias("n_short")).filter("n > 1 AND n_short > 0")
        rows = cut(rows.join(count.drop("n_short"), "key"))
        pairs = pairs.unionByName(_pairs(rows.filter(F.col("n") <= CROWD).drop("n")))
        rows = rows.filter(F.col("n") > CROWD).drop("n")
        done = F.col("hi") - F.col("lo") <= F.when(F.col("role") == "l", 2).otherwise(1)
        pairs = pairs.unionByName(_leaves(rows.filter(done)))
        crowded = cut(rows.filter(~done))
    pairs = cut(pairs)  # else the plan holds the verification once for each part of the union
    return pairs.filter(within(F.col("late"), F.col("early"))).select("id.h1", "id.h2").distinct()


def removed_places(source: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(``PLACE``) of every line that goes. ``source``: ``TEXT`` and text."""
    path, spark = shared_dir(source.sparkSession), source.sparkSession
    _occurrences(source).select(*PLACE, *_keys(), *_segments(min_chars)).write.parquet(f"{path}/places")
    places = spark.read.parquet(f"{path}/places")
    firsts = places.groupBy("h1", "h2").agg(
        F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("s0", "s1", "l0", "l1")]
    )
    firsts.write.parquet(f"{path}/distinct")
    distinct = spark.read.parquet(f"{path}/distinct")
    near = near_lines(distinct.filter("s0 IS NOT NULL"), source, path)
    near.write.parquet(f"{path}/near")
    near = spark.read.parquet(f"{path}/near").withColumn("near", F.lit(True))
    verdict = distinct.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").filter("near OR n > 1")
    found = places.select(*PLACE, "h1", "h2").join(verdict, ["h1", "h2"])
    return found.filter(F.col("near") | (F.struct(*PLACE) != F.col("first"))).select(*PLACE)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text_col``, and ``n_lines``, ``n_removed``."""
    path = shared_dir(docs.sparkSession)
    names = [f"__gone_{c}" for c in TEXT]
    gone = removed_places(_source(docs, id_col, text_col), min_chars).groupBy(*[F.col(c).alias(n) for c, n in zip(TEXT, names)])
    gone = gone.agg(F.collect_set("line_no").alias("__gone"))  # at most the lines of one text
    gone.write.parquet(f"{path}/gone")
    gone = docs.sparkSession.read.parquet(f"{path}/gone")
    # texts go once to their line numbers, at every size
    key = _text_key(id_col, text_col)
    hit = [key[c] == F.col(n) for c, n in zip(TEXT, names)]
    both = docs.join(gone.hint("merge"), hit, "left")
    # a flag for each line, then the lines that have none: linear in the text
    lines = F.split(F.col(text_col), "\n")
    keep = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone"))
    kept = let(lines, lambda x: F.array_join(F.transform(keep(x), lambda i: F.get(x, i)), "\n"))
    return both.withColumns({
        "n_lines": F.size(F.split(text_of(text_col), "\n")).cast("long"),
        "n_removed": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"),
        text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept),
    }).drop("__gone", *names)


def oracle(min_chars: int = MIN_CHARS) -> str:
    blanks = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM t),
l AS (SELECT doc_id, i, raw, trim(raw, {blanks}) AS line FROM o),
d AS (SELECT line, length(line) AS n, min((doc_id, i)) AS first FROM l WHERE length(line) > 0 GROUP BY line),
m AS (SELECT * FROM d WHERE n >= {min_chars}),
k AS (SELECT line, first, n AS base, 0 AS longer, left(line, n // 2) AS a, right(line, n - n // 2) AS b FROM m
      UNION ALL SELECT line, first, n - 1, 1, left(line, (n - 1) // 2), right(line, n - 1 - (n - 1) // 2) FROM m),
p AS (SELECT x.line AS s, x.first AS fs, y.line AS t, y.first AS ft FROM k x JOIN k y ON x.base = y.base AND x.a = y.a WHERE x.longer = 0 AND x.line <> y.line
      UNION SELECT x.line, x.first, y.line, y.first FROM k x JOIN k y ON x.base = y.base AND x.b = y.b WHERE x.longer = 0 AND x.line <> y.line),
near AS (SELECT DISTINCT CASE WHEN fs > ft THEN s ELSE t END AS line FROM p WHERE len(list_filter(range(0, length(s) + 1),
  lambda i: left(s, i) = left(t, i) AND right(s, greatest(length(s) - i - 1 + length(t) - length(s), 0)) = right(t, greatest(length(s) - i - 1 + length(t) - length(s), 0)))) > 0),
j AS (SELECT l.doc_id, l.i, l.raw, d.line IS NOT NULL AND (near.line IS NOT NULL OR (l.doc_id, l.i) <> d.first) AS gone
      FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
