"""Steps whose time or memory outgrew the tables, against plain searches of all pairs."""

import random

from pyspark.sql import functions as F

from veriframe.operators import evidence as E
from veriframe.operators import ingest as S
from veriframe.operators import matching as M
from veriframe.operators import statements


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_related_threads_are_counted_and_not_paired(spark):
    for seed in range(2):
        rng = random.Random(seed)
        members = set()
        for t in range(40):
            for s in rng.sample(["p", "q", "r", None], rng.choice([1, 1, 1, 2])):
                some = rng.sample(range(9), rng.choice([1, 2, 2, 3, 5]))
                members |= {(f"t{t:02}", s, a) for a in some} | ({(f"t{t:02}", s, None)} if t % 7 == 0 else set())
        asked = [(f"t{t:02}",) for t in range(0, 40, 3)] + [("none",)]
        got = M.related_threads(spark.createDataFrame(sorted(members, key=str) * 2, "thread_id string, source_id string, account int"), spark.createDataFrame(asked, "thread_id string")).collect()
        units = {}
        for t, s, a in members:
            units.setdefault((t, s), set()).update({a} - {None})
        want = {}
        for (t, s), mine in units.items():
            if (t,) in asked:
                shared = [(len(mine & x), s == r and s is not None) for (o, r), x in units.items() if o != t]
                shared = [n for n, same in shared if n >= (1 if same else 2)]
                head = min((u for u, x in units.items() if x == mine), key=lambda u: (u[0], u[1] or ""))
                want[t, s] = (*head, len(shared), sum(shared))
        assert {(r["thread"], r["source_id"]): (r["class_id"], r["class_source"], r["n_links"], r["n_shared"]) for r in got} == want and len(got) == len(want)


def test_headers_are_dealt_by_sheet_before_they_are_kept(spark, monkeypatch):
    monkeypatch.setattr(E, "SHEETS", 20)
    headers = spark.range(90).select((F.col("id") % 60).alias("sheet"), F.array(F.when(F.col("id") % 3 == 0, " From").otherwise("x"), F.lit("TO"), F.lit("from")).alias("cells"))
    aliases = spark.createDataFrame([("from", "sender"), ("to", "recipient")], "alias string, field string")
    found = E.header_fields(headers, aliases)
    text = plan(found)
    assert text.rindex("HashAggregate") < text.index("Exchange hashpartitioning(sheet")
    assert {tuple(r) for r in found.collect()} == {(s, "recipient", 1) for s in range(60)} | {(s, "sender", 0 if s % 3 == 0 else 2) for s in range(60)}


def test_the_parts_of_a_time_cell_are_found_once(spark):
    cells = ["1/2/2024 3:04:05 PM", " 31.12.2024 23:59(UTC-4) ", "2024-02-30 10:00 UTC+02:30", "2024-02-29T10:00:00 UTC+02:30\u2028", "1/2/24", "1/2/2024", "1|2|2024 3:04", "yesterday", "", None, "1/2/0000 3:04", "1/2/2024 3:04:60", "1/2/2024 24:00", "13/2/2024 3:04"]
    frame = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "id int, cell string").withColumn("date_order", F.lit("mdy")).withColumn("offset_min", F.lit(None).cast("int"))
    read = S.parse_times(frame, "cell", "date_order", "offset_min")
    assert read.columns == [*frame.columns, "problem", "us"]
    # each use of a part ran the whole pattern again, and a cell without a time failed in a parser
    text = read._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("UTC") <= 4 and "yyyy" not in text
    want = ["no_offset", "bad_date", "bad_date", None, "two_digit_year", "date_only", "unreadable", "unreadable", "unreadable", "unreadable", *["bad_date"] * 4]
    assert [r["problem"] for r in read.orderBy("id").collect()] == want
    assert read.filter("id = 3").first()["us"] == 1_709_191_800_000_000
    votes = S.date_order(frame.withColumn("sheet", F.lit("s")), "sheet", "cell").first()
    assert (votes["n_dmy"], votes["n_mdy"], votes["date_order"]) == (2, 0, "dmy")


def test_names_are_dealt_before_they_are_kept(spark):
    names = spark.createDataFrame([("Ann Lee",), ("ann lee",), ("LEE",), ("The Boss",), ("Ann Lee",)], "name string")
    persons = spark.createDataFrame([(1, "Ann Lee"), (2, "Bob Lee")], "person_id int, name string")
    aliases = spark.createDataFrame([(1, "the-boss"), (2, "the boss"), (2, "the boss")], "person_id int, alias string")
    found = statements.resolve_names(names, persons, aliases)
    assert plan(found).count("REPARTITION_BY_COL") == 2
    assert {tuple(r) for r in found.collect()} == {("Ann Lee", 1, 1), ("ann lee", 1, 1), ("LEE", 2, None), ("The Boss", 2, None)}
