"""Anchors, prefix invariance and batch-stream equality."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import cards as K
from touchline.operators import detect as D
from touchline.sources.bridge import match_events

SMALL = "/root/testdata/sf0.001"
SHIFT = dict(minimum_recent=4, minimum_baseline=6)


@pytest.fixture(scope="module")
def events(spark):
    return match_events(spark, SMALL).persist()


def keys(cards):
    return {(r["match_id"], r["sequence"], r["team_id"]) for r in cards.select("match_id", "sequence", "team_id").collect()}


def test_known_counts(events):
    assert D.side_shift_candidates(events, **SHIFT).count() == 9
    assert D.side_shift_cards(events, **SHIFT).count() == 5
    assert D.burst_candidates(events, minimum_ratio=(3, 2)).count() == 14
    assert D.chance_quality_cards(events).count() == 12


@pytest.mark.parametrize("cut", [500, 800])
def test_cards_before_a_cut_ignore_what_follows(events, cut):
    after = F.col("sequence") > cut
    changed = events.withColumns(
        {
            "end_x": F.when(after, 119.0).otherwise(F.col("end_x")),
            "end_y": F.when(after, 1.0).otherwise(F.col("end_y")),
            "event_type": F.when(after & (F.col("sequence") % 3 == 0), "shot").otherwise(F.col("event_type")),
            "elapsed_seconds": F.when(after, F.col("elapsed_seconds") + 30).otherwise(F.col("elapsed_seconds")),
        }
    )
    shortened = events.where(~after)
    for make in (lambda e: D.side_shift_cards(e, **SHIFT), lambda e: D.burst_cards(e, minimum_ratio=(3, 2))):
        full = {k for k in keys(make(events)) if k[1] <= cut}
        assert {k for k in keys(make(changed)) if k[1] <= cut} == full
        assert keys(make(shortened)) == full


def test_evidence_holds_every_counted_entry(events):
    cards = D.side_shift_cards(events, **SHIFT)
    entries = events.where(D.is_final_third_entry())
    found = K.evidence(cards, entries).groupBy("match_id", "team_id", "card_sequence", "role").count().collect()
    counted = {(r["match_id"], r["team_id"], r["card_sequence"], r["role"]): r["count"] for r in found}
    for c in cards.collect():
        key = (c["match_id"], c["team_id"], c["sequence"])
        assert counted[*key, "recent"] == c["recent_total"] and counted[*key, "baseline"] == c["baseline_total"]


def test_repeated_sequences_are_found(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2)], "match_id int, sequence int")
    assert [tuple(r) for r in D.order_violations(df).collect()] == [(1, 2, 2)]


def test_formation_fact_needs_a_change(spark):
    rows = [(1, 1, s, str(s), 1, 0, 0, k, f, None, None) for s, k, f in (
        (1, "starting", "442"), (5, "tactical_shift", "442"), (9, "tactical_shift", "433"), (12, "tactical_shift", "433"))]
    df = spark.createDataFrame(
        rows, "match_id int, team_id int, sequence int, event_id string, period int, minute int, second int, kind string,"
        " formation string, player_off_id int, player_on_id int")
    found = [(r["sequence"], r["kind"], r["previous_formation"], r["previous_event_id"]) for r in D.recorded_facts(df).orderBy("sequence").collect()]
    assert found == [(1, "lineup", None, None), (9, "formation_change", "442", "5")]


def test_pairing_takes_the_nearest_first(spark):
    from touchline.operators.audit import variant_pairing

    schema = "match_id int, team_id int, channel string, period int, sequence int, elapsed_seconds int"
    side = lambda *rows: spark.createDataFrame([(1, 1, "left", 1, s, e) for s, e in rows], schema)
    found = variant_pairing(side((1, 0), (2, 700), (3, 3000)), side((10, 600), (11, 1300), (12, 5000)))
    got = {(r["state"], r["current_sequence"], r["variant_sequence"], r["delay"]) for r in found.collect()}
    assert got == {
        ("paired", 2, 10, -100), ("lost", 1, None, None), ("lost", 3, None, None),
        ("new", None, 11, None), ("new", None, 12, None),
    }


def test_replay_positions_are_laid_end_to_end(spark):
    recorded = spark.createDataFrame(
        [(1, 1, 0, 0, 47, 0), (1, 2, 45, 0, 93, 0)],
        "match_id int, period int, start_minute int, start_second int, end_minute int, end_second int",
    )
    periods = K.timeline(recorded)
    items = spark.createDataFrame(
        [(1, 1, 50, 0), (1, 2, 45, 30), (1, 2, 44, 0), (1, 3, 0, 0)], "match_id int, period int, minute int, second int"
    )
    found = {(r["period"], r["minute"]): r["position"] for r in K.with_position(items, periods).collect()}
    assert found == {(1, 50): 2820, (2, 45): 2850, (2, 44): 2820, (3, 0): 5700}
    asks = spark.createDataFrame([(1, p) for p in (-5, 2820, 2821, 99999)], "match_id int, position bigint")
    clocks = {r["position"]: (r["period"], r["minute"], r["second"]) for r in K.clock_at(asks, periods).collect()}
    assert clocks == {-5: (1, 0, 0), 2820: (1, 47, 0), 2821: (2, 45, 1), 99999: (2, 93, 0)}
