"""The driver contract: every query has a name once, and core queries equal their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registered():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert oracles.keys() <= queries.keys() and len(queries) > 60


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def _cell(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", ["q_window_count_check", "q_exchanges", "q_quiet_stretches", "q_paired_match_states", "q_verdict_rules", "q_quote_cascade", "q_person_accounts", "q_time_parse_problems",
    "q_sender_check", "q_name_level", "q_hash_chain_heads", "q_review_queue", "q_window_edges", "q_period_or_nearest", "q_latest_runs", "q_field_mismatch", "q_carried_confirmations", "q_time_compare", "q_quote_skips",
    "q_resolved_names", "q_import_differences", "q_search_terms", "q_with_companions", "q_changed_claims", "q_excerpt_lines", "q_paragraph_quotes", "q_tagged_passages", "q_passage_rows"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = sorted(tuple(map(_cell, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert sorted(tuple(map(_cell, r)) for r in df.select(*columns).collect()) == want
