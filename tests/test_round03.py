"""Findings of the third review: plans and rows that were wrong before."""

import json
from datetime import UTC, date, datetime
from random import Random

import pandas as pd
from pyspark.sql import functions as F

from touchline import plans
from touchline.functions import prefix
from touchline.functions.pitch import CHANNELS
from touchline.operators import audit, detect, lineage, normalize
from touchline.plans.raw import write_by_match
from touchline.session import cut_lineage
from touchline.sources import raw
from touchline.streaming import replay

CLAIM = "claim_id string, subject string, published_at timestamp, retrieved_at timestamp, recorded_at timestamp, valid_from date, valid_until date"


def test_freeze_broadcasts_no_side(spark):
    at = datetime(2024, 1, 1)
    claims = cut_lineage(spark.createDataFrame([("c", "t", at, at, at, date(2024, 1, 1), None)], CLAIM))
    asks = cut_lineage(spark.createDataFrame([(1, "t", datetime(2024, 2, 1), date(2024, 2, 1))], "match_id int, subject string, kickoff_utc timestamp, local_date date"))
    found = lineage.freeze_at_kickoff(claims, asks)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["match_id"], r["claim_id"]) for r in found.collect()] == [(1, "c")]


def _events(spark, folder, rows):
    """An events table of (event_id, user_id, event_type) rows, a second apart; fifteen users make a match."""
    held = [(n, datetime.fromtimestamp(1704067200 + 60 * n, UTC).replace(tzinfo=None), u, kind, 1.0, '{"k": 5}') for n, u, kind in rows]
    spark.createDataFrame(held, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_unknown_types_are_rejected_in_every_match(spark, tmp_path):
    folder = _events(spark, tmp_path, [(5, 0, "click"), (6, 0, "click"), (216, 60, "click"), (217, 60, "click")])
    found = plans.QUERIES["b12_event_rejects"](spark, folder).where("reason = 'unknown event type'").collect()
    assert sorted((r["match_id"], r["records"]) for r in found) == [(0, 1), (4, 1)]
    found = plans.QUERIES["b12_adapter_rejects"](spark, folder).collect()
    assert {r["match_id"] for r in found if "unknown event type" in r["reasons"]} == {0, 4}


def test_a_match_is_written_to_one_file(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).select((F.col("id") % 5).alias("match_id"), F.col("id").cast("string").alias("record"))
    write_by_match(rows, f"{tmp_path}/lines")
    # Four partitions make at most three cuts, each inside one match.
    assert 5 <= len(list(tmp_path.glob("lines/match_id=*/*.txt"))) <= 8
    assert spark.read.text(f"{tmp_path}/lines").count() == 400


def test_many_small_files_are_one_batch(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("match_id"), F.lit('{"id": "a"}').alias("record"))
    write_by_match(rows, f"{tmp_path}/lines")
    events = replay.read_event_stream(spark, f"{tmp_path}/lines").select("match_id", "e.id")
    replay.run_to_end(events, f"{tmp_path}/state", path=f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 200
    assert len([p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()]) == 1


def test_rejects_parse_each_record_once(spark):
    line = lambda n, team: f'{{"id": "{n}", "index": {n}, "type": {{"name": "Odd"}}, "team": {{"id": {team}, "name": "A"}}}}'
    rows = [(1, line(1, 1)), (1, line(1, 3)), (2, line(1, 3)), (None, line(1, 1)), (1, '{"id": "x"}')]
    matches = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (3, 1, 2)], "match_id int, home_team_id int, away_team_id int")
    found = normalize.event_rejects(raw.parse_events(spark.createDataFrame(rows, "match_id int, record string")), matches)
    assert found._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
    got = {(r["match_id"], r["reason"]): r["records"] for r in found.collect()}
    # A match that is listed twice counts its foreign records twice; one nobody lists has none.
    assert got[1, "team is not in the match"] == 2 and (2, "team is not in the match") not in got
    assert got[1, "repeated index"] == 1 and got[1, "unknown event type"] == 3 and got[None, "unknown event type"] == 1
    assert got[1, "index must be an integer"] == 1 and got[2, "unknown event type"] == 1


def test_replay_counts_follow_the_clock():
    random = Random(3)
    settings, state, kept = replay.ReplaySettings(window_seconds=60), replay._fresh(), []
    # Steps back by up to 200 seconds, and clocks that run ahead.
    for n in range(1, 1500):
        row = {
            "match_id": 1, "sequence": n, "event_id": str(n), "period": 1 + n // 800, "elapsed_seconds": n % 800 + random.choice([0, 0, 0, -200, 40]) + 300,
            "team_id": random.choice([1, 2]), "entry_channel": random.choice([None, "left", "center", "right"]), "burst_shot": random.random() < 0.3,
            "goal_home": False, "goal_away": False, "fact_kind": None, "formation": None,
        }
        kept.append(row)
        for _ in replay._step(state, row, settings):
            pass
        if n == 700:
            state = json.loads(json.dumps(state))
            del state["totals"]  # as an older checkpoint has it
        team, period = str(row["team_id"]), str(row["period"])
        own = [r for r in kept if r["team_id"] == row["team_id"] and r["entry_channel"]]
        late = [r for r in own if r["period"] == row["period"] and r["elapsed_seconds"] > row["elapsed_seconds"] - 60]
        if own:
            count = lambda rows: [sum(r["entry_channel"] == c for r in rows) for c in CHANNELS]
            recent, before = replay._split(state, "entries", team, period, row["elapsed_seconds"] - 60)
            assert recent == count(late) and before == [a - b for a, b in zip(count(own), count(late), strict=True)]


def test_replay_rows_are_plain_values():
    frame = pd.DataFrame({"a": [1.0, float("nan")], "b": [True, None], "c": ["x", None], "d": [1, 2]})
    rows = list(replay._records(frame))
    assert rows == [{"a": 1.0, "b": True, "c": "x", "d": 1}, {"a": None, "b": None, "c": None, "d": 2}] and type(rows[0]["d"]) is int


SIDE_EVENT = (
    "match_id bigint, team_id int, player_id int, period int, sequence int, elapsed_seconds int, event_id bigint, minute int, event_type string, open_play boolean"
)


def _checks_by_hand(events, changes, window, least, share, gain):
    """Every check of two teams, each against the whole prefix."""
    out = {}
    start = {}
    for e in sorted(events, key=lambda e: e[4]):
        start.setdefault((e[0], e[3]), e[5])
    on_at = lambda m, t, p, at: max(((c[3], c[4]) for c in changes if c[:3] == (m, t, p) and c[3] <= at), default=(0, False))[1]
    for e in events:
        for team in sorted({f[1] for f in events if f[0] == e[0]}):
            if e[5] - start[e[0], e[3]] < window:
                continue
            facts = [f for f in events if f[0] == e[0] and f[1] == team and f[4] <= e[4] and f[8] == "pass" and f[9]]
            recent = [f for f in facts if f[3] == e[3] and f[5] > e[5] - window]
            earlier = [f for f in facts if f not in recent]
            best, anyone = None, False
            for p in sorted({c[2] for c in changes if c[:2] == (e[0], team)}):
                if not on_at(e[0], team, p, e[4]):
                    continue
                mine, base = sum(f[2] == p for f in recent), len(recent)
                held = [f for f in earlier if on_at(e[0], team, p, f[4])]
                was, was_base = sum(f[2] == p for f in held), len(held)
                if base < least[0] or was_base < least[1]:
                    continue
                anyone = True
                if share[1] * mine >= share[0] * base and gain[1] * (mine * was_base - was * base) >= gain[0] * base * was_base:
                    found = (round(mine / base - was / was_base, 12), -p, mine, was, was_base)
                    best = found if best is None else max(best, found)
            row = ("card", best[2], len(recent), best[3], best[4], -best[1]) if best else ("no_change" if anyone else "insufficient_data", None, len(recent), None, None, None)
            out[e[0], team, e[4]] = row
    return out


def test_involvement_over_blocks_equals_every_prefix(spark):
    random, events, changes = Random(3), [], []
    for match in (1, 2):
        for n in range(1, 161):
            period, clock = (1, 4 * n) if n <= 80 else (2, 4 * (n - 80))
            if random.random() < 0.1:
                clock = max(0, clock - random.choice((10, 90)))
            events.append((match, random.choice((1, 2)), random.choice((1, 2, 3, 4, None)), period, n, clock, 1000 * match + n, clock // 60, random.choice(("pass", "pass", "shot")), random.random() < 0.9))
        changes += [(match, t, p, 1, True) for t in (1, 2) for p in (1, 2, 3)]
        changes += [(match, 1, 2, 50, False), (match, 1, 4, 50, True), (match, 2, 1, 90, False), (match, 2, 1, 90, True), (match, 1, 2, 120, True)]
    rule = dict(window_seconds=60, minimum_recent=3, minimum_baseline=4)
    wanted = _checks_by_hand(events, changes, 60, (3, 4), (20, 100), (10, 100))
    frame = cut_lineage(spark.createDataFrame(events, SIDE_EVENT))
    turns = cut_lineage(spark.createDataFrame(changes, "match_id bigint, team_id int, player_id int, sequence int, on boolean"))
    for size in (9, 4096):
        checks = detect.involvement_checks(frame, turns, block_rows=size, **rule)
        found = {(r["match_id"], r["team_id"], r["sequence"]): (r["outcome"], r["recent_value"], r["recent_base"], r["earlier_value"], r["earlier_base"], r["player_id"]) for r in checks.collect()}
        assert found == wanted
        # No row per event and squad member.
        assert "_salt" not in checks._jdf.queryExecution().toString()
    assert {row[0] for row in wanted.values()} == {"card", "no_change", "insufficient_data"}


def test_the_event_before_a_card_may_lie_in_another_block(spark):
    at = {1: [1, 2, 3, 4096, 4097, 4098, 20000, 20001], 2: [5], 3: [8192, 8193]}
    events = cut_lineage(spark.createDataFrame([(m, n, 1 + n // 5000, 2 * n) for m, ns in at.items() for n in ns], "match_id bigint, sequence int, period int, elapsed_seconds int"))
    cards = cut_lineage(spark.createDataFrame([(m, n) for m, ns in at.items() for n in ns if n != 4098] + [(1, 2)], "match_id bigint, sequence int"))
    found = {(r["match_id"], r["sequence"]): (r["prior_period"], r["prior"]) for r in audit.events_before(events, cards).collect()}
    wanted = {}
    for match, ns in at.items():
        for n in ns:
            before = [b for b in ns if b < n]
            wanted[match, n] = (1 + before[-1] // 5000, 2 * before[-1]) if before else (None, None)
    assert found == {k: v for k, v in wanted.items() if k != (1, 4098)}
    # No window over all events of a match: events shrink to a row per card and block before they are ordered.
    plan = audit.events_before(events, cards)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate") and plan.count("Window [") == 1


def test_sides_and_period_starts_are_one_join(spark):
    random = Random(5)
    rows = [(1, random.choice((1, 2)), 1, 1 + n // 6000, n, n % 6000) for n in range(1, 9001)] + [(2, None, None, 1, 1, 3), (2, 2, 4, 1, 2, 1), (3, None, 1, 1, 1, 0)]
    events = cut_lineage(spark.createDataFrame(rows, "match_id bigint, team_id int, player_id int, period int, sequence int, elapsed_seconds int"))
    found = detect.sides_from_start(events, events.select("match_id", "team_id", "period", "sequence", "elapsed_seconds"))
    wanted = detect.with_period_start(events, detect.per_side(events).where("team_id is not null"))
    key = ["match_id", "period", "sequence", "actor_id", "team_id", "period_start"]
    assert sorted(map(tuple, found.select(*key).collect()), key=str) == sorted(map(tuple, wanted.select(*key).collect()), key=str)
    assert "_salt" not in found._jdf.queryExecution().toString()


def test_side_shift_doubles_rows_after_one_shuffle(spark):
    shape = SIDE_EVENT + ", second int, completed boolean, x double, end_x double, end_y double"
    events = cut_lineage(spark.createDataFrame([], shape))
    plan = detect.side_shift_windows(events, fire_on_own_entry=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "explode(_teams" in plan


def test_null_shots_are_laid_out_once(spark):
    shape = SIDE_EVENT + ", second int, penalty boolean, completed boolean, x double, end_x double"
    kinds = ("shot", "pass", "shot")
    rows = [(m, 1 + n % 2, 1, 1, n, 3 * n, 1000 * m + n, n // 20, kinds[n % 3], True, 3 * n % 60, False, True, 50.0, 50.0) for m in (1, 2) for n in range(1, 601)]
    events = cut_lineage(spark.createDataFrame(rows, shape))
    plan = audit.null_shot_baseline(events, seeds=2)._jdf.queryExecution().optimizedPlan().toString()
    # Spots are hashed when the stream is written, not again by each reader; short streams are not repeated by salts.
    assert "md5" not in plan and "_salt" not in plan
    stream = audit.null_shot_stream(events, seeds=2).collect()
    assert sum(r["event_type"] == "shot" for r in stream) == 2 * sum(r[8] == "shot" for r in rows)
    for key in {r["match_id"] for r in stream}:
        own = sorted((r for r in stream if r["match_id"] == key), key=lambda r: r["sequence"])
        assert [r["sequence"] for r in own] == list(range(1, len(own) + 1))
        order = [(r["period"], r["elapsed_seconds"], r["event_type"] == "shot", r["event_id"] or 0) for r in own]
        assert order == sorted(order)


def test_a_join_per_block_meets_every_row(spark):
    rows = cut_lineage(spark.createDataFrame([(m, n) for m in (1, 2, 3) for n in (1, 2, 5000, 9000, 9001)], "match_id bigint, sequence int"))
    small = cut_lineage(spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "match_id bigint, v string"))
    found = prefix.join_per_block(rows, small, ["match_id"]).select("match_id", "sequence", "v").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, rows.join(small, "match_id").collect()))
