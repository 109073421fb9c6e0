"""Personal data (1): labelers that vote, EM over their votes, and a span classifier.

Base spans are exact: four patterns, leftmost and non-overlapping for each kind, with the checks
of their kind; they always stay. Wider patterns propose more spans (spelled-out addresses,
telephone numbers without a country code, names, credentials). Six labelers - shape, check,
gazetteer, context, boundary, placeholder - vote on every span: +1, -1, or 0 if they have no
opinion.

``fit`` counts how often each pattern of votes and shape occurs in the whole corpus. That table
is bounded by the number of patterns, whatever the corpus, so expectation-maximisation (two
classes, a reliability for each labeler and kind) and the logistic classifier trained on its
posteriors run on the driver in a few steps of plain arithmetic. ``spans`` compiles the
classifier into the projection that finds the spans. Everything else is a row-local expression:
no user function, no join, no shuffle but that of the pattern counts.

A null text counts as empty: no spans. Positions are code points, the end exclusive. Rows are
answered one by one, so repeated ids and rows each get their own answer; other columns stay.
Pattern loops are possessive, so a text of one endless run of digits costs linear time; the
context of a span is cut where it is found, and overlaps are looked for in blocks of spans.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import let, text_of

KINDS = ("email", "ip", "card", "phone", "name", "secret")
LABELERS = ("shape", "check", "gazetteer", "context", "boundary", "placeholder")

_LOCAL = "A-Za-z0-9._%+-"
#: kind, pattern, what a text must contain to be searched at all
BASE = (
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)

# Common given names, titles, top-level domains, card and country prefixes, cue words.
GIVEN = (
    "James|Mary|John|Linda|Robert|Susan|Michael|David|Sarah|Thomas|Anna|Peter|Paul|Laura|Emma|Maria|Juan|Carlos|Carmen|"
    "Pedro|Lucia|Jean|Pierre|Marie|Claire|Louis|Hans|Klaus|Heidi|Jürgen|Ursula|Stefan|Sofia|Elena|Ahmed|Fatima|Wei|Yuki"
)
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Señor|Señora"
TLDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|eu|us|ca|ch|at|nl|be|br|mx|ar"
CARD_PREFIXES = r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|3[68]"
COUNTRY_CODES = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
CUES = {
    "email": "mail|contact|write|reach|address|courriel|correo",
    "ip": r"\bip\b|host|server|address|from|login|adresse",
    "card": "card|visa|credit|pay|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|ring|anruf|teléfono|téléphone",
    "name": "name|dear|signed|by|regards|mr|mrs|ms|dr|herr|frau|mme|llamo|heiße|appelle",
    "secret": "token|secret|passw|key",
}
AGAINST = r"version|isbn|order|invoice|\bno\b|nr\b|chapter|figure|page"

#: The wider patterns: kind, pattern, what a text must contain
_NAME_WORD = r"\p{Lu}[\p{L}'’-]{1,30}+"
WIDER = (
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\s?(?:\(at\)|\[at\]|\bat\b)\s?[A-Za-z0-9-]{{1,63}}+(?:\s?(?:\(dot\)|\[dot\]|\bdot\b)\s?[A-Za-z]{{2,24}}+)+", r"\bdot\b"),
    ("phone", r"(?<![0-9A-Za-z+.)\x20-]|[0-9+)]\x20)(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{3,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])|(?<=[a-zA-Z:]\x20)(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{3,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])", r"[0-9]{3,4}[\x20.-][0-9]{4}"),
    ("name", rf"(?<=\b(?:{TITLES})\.?\x20){_NAME_WORD}(?:\x20{_NAME_WORD}){{0,2}}+|(?<=(?:name is|je m'appelle|me llamo|ich heiße)\x20){_NAME_WORD}(?:\x20{_NAME_WORD}){{0,2}}+|\b(?:{GIVEN})\x20{_NAME_WORD}(?:\x20{_NAME_WORD}){{0,1}}+",
     rf"\b(?:{TITLES}|{GIVEN}|name is|m'appelle|llamo|heiße)\b"),
    ("secret", r"(?<=(?:token|secret|password|passwd|api_key|apikey|access_key)\x20{0,2}[=:]\x20{0,2}[\"']?)[A-Za-z0-9_/+-]{16,512}+", r"(?:token|secret|password|passwd|api_?key|access_key)\x20{0,2}[=:]"),
)


def _running(values: Column) -> Column:
    """Sums from the first element on, in blocks so that the cost stays linear."""
    block = 256
    scan = lambda xs, start: F.aggregate(
        xs,
        F.struct(start.alias("sum"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct((a.sum + x).alias("sum"), F.concat(a.all, F.array(a.sum + x)).alias("all")),
        lambda a: a.all,
    )
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / block), F.lit(0)).cast("int")),
        lambda b: F.slice(values, b * block + 1, block),
    )
    return let(
        blocks,
        lambda bs: let(
            F.concat(F.array(F.lit(0)), scan(F.transform(bs, total), F.lit(0))),
            lambda offsets: F.flatten(F.transform(bs, lambda b, i: scan(b, F.get(offsets, i)))),
        ),
    )


_SPAN = "array<struct<start:int,kind:int,end:int,m:string,before:string,after:string>>"
_NEAR = 24


def _matches(text: Column, kind: str, pattern: str, guard: str) -> Column:
    def placed(t: Column) -> Column:
        sizes = F.zip_with(F.slice(t.gaps, F.lit(1), F.size(t.found)), t.found, lambda g, m: F.length(g) + F.length(m))

        def span(end: Column, i: Column) -> Column:
            m = F.get(t.found, i)
            before = F.concat(F.coalesce(F.get(t.found, i - 1), F.lit("")), F.right(F.get(t.gaps, i), F.lit(_NEAR)))
            return F.struct(
                (end - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), m.alias("m"),
                F.lower(F.right(before, F.lit(_NEAR))).alias("before"), F.left(F.get(t.gaps, i + 1), F.lit(1)).alias("after"),
            )

        return F.transform(_running(sizes), span)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    found = let(both, lambda t: F.when(F.size(t.found) > 0, placed(t)).otherwise(F.array().cast(_SPAN)))
    return F.when(text.rlike(guard), found).otherwise(F.array().cast(_SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    parts = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(parts, lambda c, i: let(F.ascii(c) - 48, lambda d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The check that a base match must pass."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    def passing(kind: str, pattern: str, guard: str) -> Column:
        return F.filter(_matches(text, kind, pattern, guard), lambda s: _valid(kind, s.m))

    return F.concat(*[passing(*row) for row in BASE])


def wider_spans(text: Column) -> Column:
    return F.concat(*[_matches(text, k, p, g) for k, p, g in WIDER])


# ------------------------------------------------------------------- labelers
def _by_kind(kind: Column, cases: dict[str, Column], other: Column) -> Column:
    out = None
    for name, value in cases.items():
        hit = kind == KINDS.index(name)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(other)


def _vote(yes: Column, no: Column | None = None) -> Column:
    no = ~yes if no is None else no
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(span: Column) -> Column:
    """The labelers' votes and two shape buckets of a span, as a struct of small integers.

    Its context was cut where it was found: what stands before it back to the end of the match
    but one (``_NEAR`` code points at most), and the code point after it.
    """
    m, kind, before, after = span.m, span.kind, span.before, span.after
    zero = F.lit(0)
    digit_share = let(F.length(_digits(m)) / F.greatest(F.length(m), F.lit(1)), lambda s: F.when(s < 0.1, 0).when(s < 0.7, 1).otherwise(2))
    shape = _by_kind(kind, {
        "email": _vote(m.rlike(r"@[A-Za-z0-9-]+\.|dot")), "ip": _vote(F.length(m) >= 7), "card": _vote(_digits(m).rlike("^[0-9]{15,16}$")),
        "phone": _vote(_digits(m).rlike("^[0-9]{9,15}$")), "name": _vote(m.contains(" ")), "secret": _vote(m.rlike("[0-9]") & m.rlike("[A-Za-z]")),
    }, zero)
    check = _by_kind(kind, {
        "email": _vote(m.rlike(r"^[^.].*[^.]@|at")), "ip": _vote(_valid("ip", m)), "card": _vote(_valid("card", m)), "phone": _vote(_valid("phone", m)),
        "name": _vote(~m.rlike(r"\p{Lu}{3,}")), "secret": _vote(F.length(m) >= 20),
    }, zero)
    gazetteer = _by_kind(kind, {
        "email": _vote(m.rlike(rf"(?i)(?:\.|dot\W?\s?)(?:{TLDS})$"), F.lit(False)), "ip": _vote(~m.rlike(r"^(?:0|127|255)\.")),
        "card": _vote(m.rlike(f"^(?:{CARD_PREFIXES})")), "phone": _vote(m.rlike(f"^{COUNTRY_CODES}"), F.lit(False)),
        "name": _vote(m.rlike(rf"^(?:{GIVEN})\b"), F.lit(False)),
    }, zero)
    cue = _by_kind(kind, {k: before.rlike(v) for k, v in CUES.items()}, F.lit(False))
    boundary = _vote(~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^[\p{L}\p{N}]"))
    fake = m.rlike(r"(?i)example|test|\.invalid|([0-9])\1{5}|123456789|xxxx")
    return F.struct(
        kind.alias("kind"), shape.alias("shape"), check.alias("check"), gazetteer.alias("gazetteer"),
        _vote(cue, before.rlike(AGAINST)).alias("context"), boundary.alias("boundary"), F.when(fake, -1).otherwise(0).alias("placeholder"),
        F.when(F.length(m) < 12, 0).when(F.length(m) < 24, 1).otherwise(2).alias("length"), digit_share.alias("digits"),
    )


# -------------------------------------------------------------------- fitting
@dataclass
class Model:
    """Weights of the span classifier, by (feature, value), and a bias for each kind."""

    bias: dict[int, float] = field(default_factory=dict)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    reliability: dict[tuple[int, str], float] = field(default_factory=dict)

    def score(self, v: Column) -> Column:
        terms = [F.lit(0.0)]
        if self.bias:
            terms.append(_table(v.kind, self.bias))
        for name in (*LABELERS, "length", "digits"):
            if found := {value: w for (n, value), w in self.weights.items() if n == name}:
                terms.append(_table(v[name], found))
        return 1 / (1 + F.exp(-sum(terms[1:], terms[0])))


def _table(c: Column, values: dict[int, float]) -> Column:
    out = None
    for key, w in sorted(values.items()):
        out = F.when(c == key, w) if out is None else out.when(c == key, w)
    return out.otherwise(0.0)


def expectation_maximisation(table: list[dict], rounds: int = 40) -> tuple[list[float], dict[tuple[int, str], float]]:
    """Posteriors of the patterns of ``table`` (votes, n) and each labeler's reliability by kind."""
    kinds = {r["kind"] for r in table}
    right = {(k, name): 0.75 for k in kinds for name in LABELERS}
    prior = {k: 0.5 for k in kinds}
    post = [0.5] * len(table)
    for _ in range(rounds):
        for j, r in enumerate(table):
            odds = log(prior[r["kind"]] / (1 - prior[r["kind"]]))
            odds += sum(r[name] * log(a / (1 - a)) for name in LABELERS if r[name] for a in [right[r["kind"], name]])
            post[j] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        for k in kinds:
            mine = [(r, p) for r, p in zip(table, post) if r["kind"] == k]
            n = sum(r["n"] for r, _ in mine)
            prior[k] = min(0.95, max(0.05, (sum(r["n"] * p for r, p in mine) + 1) / (n + 2)))
            for name in LABELERS:
                agree = sum(r["n"] * (p if r[name] > 0 else 1 - p) for r, p in mine if r[name])
                said = sum(r["n"] for r, _ in mine if r[name])
                # smoothed towards its start; a labeler is never taken for worse than chance
                right[k, name] = min(0.98, max(0.5, (agree + 7.5) / (said + 10)))
    return post, right


def train(table: list[dict], post: list[float], rounds: int = 300, rate: float = 1.0, shrink: float = 1e-3) -> Model:
    """A logistic classifier of the spans, with the posteriors as its targets."""
    model = Model()
    total = sum(r["n"] for r in table) or 1
    names = (*LABELERS, "length", "digits")
    for _ in range(rounds):
        slope: dict = {}
        for r, p in zip(table, post):
            z = model.bias.get(r["kind"], 0.0) + sum(model.weights.get((n, r[n]), 0.0) for n in names)
            g = r["n"] * (p - 1 / (1 + exp(-max(-30.0, min(30.0, z))))) / total
            for key in [r["kind"], *((n, r[n]) for n in names)]:
                slope[key] = slope.get(key, 0.0) + g
        for key, g in slope.items():
            store = model.weights if isinstance(key, tuple) else model.bias
            store[key] = store.get(key, 0.0) * (1 - shrink * rate) + rate * g
    return model


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The classifier, from the votes on all spans of all documents."""
    text = text_of(text_col)
    spans = docs.select(F.explode(F.concat(base_spans(text), wider_spans(text))).alias("s"))
    patterns = spans.select(votes(F.col("s")).alias("v")).select("v.*")
    counted = patterns.groupBy(*patterns.columns).agg(F.count("*").alias("n"))
    table = [r.asDict() for r in counted.collect()]  # at most kinds x votes x buckets rows
    table.sort(key=lambda r: sorted(r.items()))
    post, right = expectation_maximisation(table)
    model = train(table, post)
    model.reliability = right
    return model


# -------------------------------------------------------------------- results
def spans(docs: DataFrame, model: Model, text_col: str = "text", out: str = "pii", threshold: float = 0.5) -> DataFrame:
    """``docs`` with a struct ``out``: ``base`` and ``spans``, arrays of (start, kind, end, m) in order.

    ``spans`` holds the base spans and the wider ones that the classifier accepts and no base
    span overlaps.
    """
    text = text_of(text_col)
    bare = lambda xs: F.transform(xs, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), s.m.alias("m")))
    found = F.struct(F.array_sort(bare(base_spans(text))).alias("base"), wider_spans(text).alias("wider"))
    found = let(found, lambda t: F.struct(t.base.alias("base"), t.wider.alias("wider"), F.when(F.size(t.wider) > 0, _blocks(t.base)).alias("blocks")))

    def accepted(t: Column) -> Column:
        more = F.filter(t.wider, lambda s: ~_overlaps(s, t.blocks) & (model.score(votes(s)) >= threshold))
        both = F.when(F.size(t.wider) > 0, F.array_sort(F.array_distinct(F.concat(t.base, bare(more))))).otherwise(t.base)
        return F.struct(t.base.alias("base"), both.alias("spans"))

    return docs.withColumn(out, let(found, accepted))


def _blocks(spans: Column) -> Column:
    """Sorted spans in blocks, with the first start and the last end of each."""
    size = 128
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(spans) / size).cast("int")), lambda b: F.slice(spans, b * size + 1, size))
    return F.transform(F.filter(cut, lambda xs: F.size(xs) > 0), lambda xs: F.struct(
        F.get(xs, F.lit(0)).start.alias("lo"), F.array_max(F.transform(xs, lambda s: s.end)).alias("hi"), xs.alias("xs")
    ))


def _overlaps(span: Column, blocks: Column) -> Column:
    """Whether any span of the blocks overlaps; only blocks that reach it are looked into."""
    meets = lambda b: (b.start < span.end) & (span.start < b.end)
    return F.exists(blocks, lambda k: F.when((k.lo < span.end) & (span.start < k.hi), F.exists(k.xs, meets)).otherwise(F.lit(False)))


def listed(found: Column) -> Column:
    """kind:start:end, comma between."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s.kind == KINDS.index(kind))).cast("long")
