"""The registry, a sample of queries against their SQL, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "e1_event_context", "f2_team_time_bins", "f5_window_pairs", "g1_player_intervals", "h4_side_shift_cards", "h6_burst_cards",
    "h16_render_cards", "i8_auc", "b5_normalize_events", "c16_quality_report", "j5_value_bins", "k3_review_sample", "l3_stream_detectors",
]


def test_names_and_sql_match():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 140


def test_every_sql_can_be_planned():
    base = duckdb.connect()
    for name in TABLES:
        base.sql(f"create view {name} as from '{FOLDER}/{name}.parquet'")
    for name, sql in entry.oracle_sql().items():
        base.execute("explain " + sql)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    base.sql("set timezone='UTC'")
    for table in TABLES:
        base.sql(f"create view {table} as from '{FOLDER}/{table}.parquet'")
    frame = entry.queries()[name](spark, FOLDER)
    found = base.execute(entry.oracle_sql()[name])
    result = compare(frame.columns, [tuple(r) for r in frame.collect()], [c[0] for c in found.description], found.fetchall())
    assert result.startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() == 5
