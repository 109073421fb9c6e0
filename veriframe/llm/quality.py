"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are ``[^\\x20\\x09-\\x0D]+``; a null text counts as an empty one. Every measure is a
built-in expression over the row, so the plan is scan and project: no shuffle, no state, and
a row never meets another. An empty text has zero words and fails the base rule. Ratios over
zero words are zero. Rows with equal ids are each judged by themselves; extra columns pass
through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import let, text_of, words_of

#: Words a window has, and the shares (percent) and counts of the base rule.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au das de del der des die du ein eine el en es et für ist la las le les los mit nicht "
    "para pas por pour que qui se sich sur un una und une von y zu avec con dans ne no"
).split()

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``, held to only from ``from_words`` words on."""

    name: str
    measure: str
    low: float = 0.0
    high: float = float("inf")
    from_words: int = 0


#: The table that ``verdict`` compiles; replace or extend it to change the policy.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", "symbol_ratio", 0.0, 0.1),
    Rule("stop_word_ratio", "stop_ratio", 0.04, 1.0, from_words=40),
    Rule("upper_case_ratio", "upper_ratio", 0.0, 0.4),
    Rule("emphasis_ratio", "emphasis_ratio", 0.0, 0.5),
    Rule("duplicate_line_ratio", "dup_line_ratio", 0.0, 0.5),
)


def _repeated_words(words: Column) -> Column:
    """Words inside windows whose word sequence stands in the text at least twice.

    The windows' hashes are compared first as a set; only a text in which two are equal pays
    for sorting them with their positions.
    """
    hashes = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
            lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
        ),
    )

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(
            by_hash,
            lambda s: F.filter(
                s,
                lambda e, j: (e.x == F.get(s, j + 1).x).eqNullSafe(True) | (e.x == F.get(s, j - 1).x).eqNullSafe(True),
            ),
        )
        at = F.sort_array(F.transform(twice, lambda e: e.i))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            at,
            zero,
            lambda a, p: F.struct(
                (p + WINDOW).alias("end"), (a.n + p + WINDOW - F.greatest(p, a.end)).cast("long").alias("n")
            ),
            lambda a: a.n,
        )

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
MEASURES = (*COUNTS, "mean_word_chars", "symbol_ratio", "stop_ratio", "upper_ratio", "emphasis_ratio", "dup_line_ratio")


def _parts(text: Column) -> Column:
    return F.struct(
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )


def _counts(text: Column, parts: Column) -> Column:
    words, lines = parts.words, parts.lines
    long = lambda c: c.cast("long")
    return F.struct(
        long(F.size(words)).alias("n_words"),
        long(F.length(F.array_join(words, ""))).alias("word_chars"),
        long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size(lines)).alias("n_lines"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        _repeated_words(words).alias("n_repeat_words"),
        long(F.size(F.filter(words, lambda w: w.isin(STOP_WORDS)))).alias("n_stop_words"),
        long(F.regexp_count(text, F.lit(r"\p{Lu}"))).alias("n_upper"),
        long(F.regexp_count(text, F.lit("[!?]"))).alias("n_emphasis"),
    )


def _ratios(m: Column) -> Column:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return F.struct(
        *[m[c].alias(c) for c in COUNTS],
        ratio(m.word_chars, m.n_words).alias("mean_word_chars"),
        ratio(m.n_symbols, m.n_words).alias("symbol_ratio"),
        ratio(m.n_stop_words, m.n_words).alias("stop_ratio"),
        ratio(m.n_upper, m.word_chars).alias("upper_ratio"),
        ratio(m.n_emphasis, m.n_words).alias("emphasis_ratio"),
        ratio(m.n_dup_lines, m.n_lines).alias("dup_line_ratio"),
    )


def measures(text: Column) -> Column:
    """All counts and ratios of a text, as one struct.

    Each step is bound once, so that a filter on the result which Spark pushes below it holds
    every measure once too.
    """
    return let(let(_parts(text), lambda p: _counts(text, p)), _ratios)


def base_failed(m: Column) -> Column:
    return (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The first rule a row breaks, null if it breaks none."""
    broken = [
        F.when((m.n_words >= r.from_words) & ~m[r.measure].between(r.low, r.high), F.lit(r.name)) for r in rules
    ]
    return F.coalesce(F.when(base_failed(m), F.lit("base")), *broken)


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "_quality") -> DataFrame:
    """``docs`` with ``out``: all measures, ``broken`` (first broken rule or null) and ``kept``."""
    judged = let(measures(text_of(text_col)), lambda m: F.struct(m.alias("m"), verdict(m, rules).alias("broken")))
    flat = lambda j: [*[j.m[c].alias(c) for c in MEASURES], j.broken.alias("broken"), j.broken.isNull().alias("kept")]
    return docs.withColumn(out, let(judged, lambda j: F.struct(*flat(j))))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    broken = " OR ".join(
        f"(n_words >= {r.from_words} AND NOT {r.measure} BETWEEN {r.low} AND {'1e300' if r.high == float('inf') else r.high})"
        for r in rules
    )
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text,
        list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM v, range(0, {WINDOW}) AS o(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda x: x IN ({stop}))) AS n_stop_words,
        length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^!?]', '', 'g')) AS n_emphasis
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
        CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_ratio,
        CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio,
        CASE WHEN n_words > 0 THEN n_emphasis / n_words ELSE 0 END AS emphasis_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({broken}) AS kept FROM q
"""
