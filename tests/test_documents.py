"""One JSON document per match, laid out and put together by chunks."""

import glob
import json

import pytest

from touchline.operators import export as E


@pytest.fixture
def frames(spark):
    matches = spark.createDataFrame(
        [(1, "Cup", "2024", "2024-05-01", 10, 'A "One"', 20, "B\nTwo"), (2, "Cup", "2024", "2024-05-02", 10, "A", 30, "é")],
        "match_id bigint, competition_name string, season_name string, match_date string, home_team_id int, home_team_name string, away_team_id int, away_team_name string",
    ).selectExpr("*", "cast(match_date as date) as _d").drop("match_date").withColumnRenamed("_d", "match_date")
    periods = spark.createDataFrame([(1, 1, 0, 0, 45, 2), (1, 2, 45, 0, 90, 0)], "match_id bigint, period int, start_minute int, start_second int, end_minute int, end_second int")
    goals = spark.createDataFrame(
        [(1, 100 + k, k, 1, k, 3, 10, False, k == 5, k, 0) for k in range(1, 40)],
        "match_id bigint, event_id bigint, sequence int, period int, minute int, second int, team_id int, own_goal boolean, penalty boolean, home_score bigint, away_score bigint",
    )
    cards = spark.createDataFrame(
        [(1, 10, 7, 7, 1, 12, 1, "burst", 0, True, 1, 0, "burst-7"), (1, 10, 7, 7, 1, 12, 1, "side_shift", 1, False, 1, 0, "side_shift-7"), (1, 20, 900, 900, 2, 50, 0, "burst", 0, True, 1, 0, "burst-900")],
        "match_id bigint, team_id int, sequence int, event_id bigint, period int, minute int, second int, kind string, kind_rank int, experimental boolean, home_score bigint, away_score bigint, card_id string",
    )
    sentences = spark.createDataFrame(
        [(1, 10, 7, "burst", "Many shots."), (1, 10, 7, "side_shift", 'More "left".'), (1, 20, 900, "burst", "Late."), (1, 20, 3, "lineup", "Started."), (2, 10, 4, "lineup", "Started too.")],
        "match_id bigint, team_id int, event_id bigint, kind string, sentence string",
    )
    evidence = spark.createDataFrame(
        [(1, "burst-7", e, "shot" if e % 2 else "recent", e, 1, 10, e, 10, "shot" if e % 2 else "pass", 1.5, 2.0, None if e % 2 else 3.0, None if e % 2 else 4.0) for e in range(1, 7)],
        "match_id bigint, card_id string, event_id bigint, role string, sequence int, period int, minute int, second int, team_id int, action string, start_x double, start_y double, end_x double, end_y double",
    )
    lines = spark.createDataFrame(
        [(1, "burst-7", 2, 9, "  second"), (1, "burst-7", 1, 0, "  first"), (1, "side_shift-7", 1, 0, "  other")], "match_id bigint, card_id string, section int, position bigint, text string"
    )
    facts = spark.createDataFrame(
        [(1, 20, 3, 3, 1, 0, 9, "lineup"), (2, 10, 4, 4, 1, 1, 0, "lineup")], "match_id bigint, team_id int, sequence int, event_id bigint, period int, minute int, second int, kind string"
    )
    return matches, periods, goals, cards, sentences, evidence, lines, facts


def expected():
    clock = lambda p, m, s: {"period": p, "minute": m, "second": s}
    shown = [
        {"event_id": e, "role": "shot" if e % 2 else "recent", "clock": clock(1, 10, e), "team_id": 10, "action": "shot" if e % 2 else "pass",
         "start": {"x": 1.5, "y": 2.0}, "end": None if e % 2 else {"x": 3.0, "y": 4.0}}
        for e in (1, 3, 5, 2, 4, 6)
    ]
    card = lambda kind, trial, team, at, event, sentence, lines, rows: {
        "id": f"{kind}-{event}", "kind": kind, "experimental": trial, "team_id": team, "clock": at, "trigger_event_id": event, "score": {"home": 1, "away": 0},
        "sentence": sentence, "evidence_lines": lines, "evidence": rows, "sources": ["src"],
    }
    return {
        "schema_version": 1, "attribution": "Data: x",
        "match": {"id": 1, "competition": "Cup", "season": "2024", "date": "2024-05-01", "home": {"id": 10, "name": 'A "One"'}, "away": {"id": 20, "name": "B\nTwo"}},
        "periods": [
            {"period": 1, "start": clock(1, 0, 0), "end": clock(1, 45, 2)}, {"period": 2, "start": clock(2, 45, 0), "end": clock(2, 90, 0)},
        ],
        "goals": [{"event_id": 100 + k, "clock": clock(1, k, 3), "team_id": 10, "own_goal": False, "penalty": k == 5, "score": {"home": k, "away": 0}} for k in range(1, 40)],
        "cards": [
            card("burst", True, 10, clock(1, 12, 1), 7, "Many shots.", ["first", "second"], shown),
            card("side_shift", False, 10, clock(1, 12, 1), 7, 'More "left".', ["other"], []),
            card("burst", True, 20, clock(2, 50, 0), 900, "Late.", [], []),
        ],
        "facts": [{"clock": clock(1, 0, 9), "kind": "lineup", "team_id": 20, "sentence": "Started.", "event_id": 3}],
    }


@pytest.mark.parametrize("chunk_bytes", [1, 300, 10**7])
def test_documents_are_whole_whatever_the_chunks(spark, frames, tmp_path, chunk_bytes):
    chunks = E.document_chunks(E.document_pieces(*frames, "Data: x", "src"), chunk_bytes)
    rows = sorted((r["match_id"], r["chunk"], r["text"]) for r in chunks.collect())
    documents = {m: "".join(t for k, _, t in rows if k == m) for m in (1, 2)}
    assert json.loads(documents[1]) == expected()
    assert json.loads(documents[2]) == expected() | {
        "match": {"id": 2, "competition": "Cup", "season": "2024", "date": "2024-05-02", "home": {"id": 10, "name": "A"}, "away": {"id": 30, "name": "é"}},
        "periods": [], "goals": [], "cards": [],
        "facts": [{"clock": {"period": 1, "minute": 1, "second": 0}, "kind": "lineup", "team_id": 10, "sentence": "Started too.", "event_id": 4}],
    }
    # No chunk is longer than asked for by more than a piece, and short chunks are many.
    assert max(len(t) for *_, t in rows) < chunk_bytes + 600 and (chunk_bytes > 300 or len(rows) > 20)
    E.write_documents(chunks, frames[0], str(tmp_path))
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_path}/documents/match_id=1/part-*")))
    assert json.loads(text) == expected()
    index = [json.loads(line) for f in glob.glob(f"{tmp_path}/index/part-*") for line in open(f, encoding="utf-8")]
    assert sorted(index[0]) == ["away_team_name", "competition_name", "home_team_name", "match_date", "match_id", "season_name"] and len(index) == 2
