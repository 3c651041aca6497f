"""Nested provider records to flat typed rows. Unknown shapes are rejected, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import clock as K

# Provider event types and the vocabulary they map to.
ACTIONS = {
    "Pass": "pass", "Carry": "carry", "Shot": "shot", "Pressure": "pressure", "Duel": "duel", "50/50": "duel",
    "Dribble": "dribble", "Ball Recovery": "ball_recovery", "Interception": "interception",
    "Clearance": "clearance", "Block": "block", "Foul Committed": "foul", "Foul Won": "foul",
    "Goal Keeper": "goalkeeper", "Substitution": "substitution", "Starting XI": "formation_change",
    "Tactical Shift": "formation_change", "Half Start": "period_start", "Half End": "period_end",
    "Ball Receipt*": "other", "Miscontrol": "other", "Dispossessed": "other", "Dribbled Past": "other",
    "Shield": "other", "Error": "other", "Offside": "other", "Bad Behaviour": "other",
    "Injury Stoppage": "other", "Referee Ball-Drop": "other", "Player On": "other", "Player Off": "other",
    "Own Goal For": "other", "Own Goal Against": "other", "Camera On": "other", "Camera off": "other",
}
SET_PIECE_PASSES = ("Corner", "Free Kick", "Throw-in", "Goal Kick", "Kick Off")
OPEN_PASSES = ("Recovery", "Interception")
OPEN_SHOTS = ("Open Play", "Free Kick", "Corner", "Kick Off")
CARDS_OFF = ("Red Card", "Second Yellow")


def action_type(name) -> Column:
    """The vocabulary of an event type name, NULL when the name is unknown."""
    pairs = [F.lit(v) for pair in ACTIONS.items() for v in pair]
    return F.element_at(F.create_map(*pairs), name)


def _size_is(column: Column, *sizes: int) -> Column:
    return F.coalesce(F.size(column).isin(*sizes) & ~F.exists(column, lambda v: v.isNull()), F.lit(False))


def event_reasons() -> Column:
    """Why a parsed record cannot be used: an array of fixed reasons, empty when it can."""
    e = lambda path: F.col(f"e.{path}")
    kind = F.col("_action")
    tactics = kind == "formation_change"
    starting = e("type.name") == "Starting XI"
    distinct = F.size(F.array_distinct(F.transform(e("tactics.lineup"), lambda p: p["player"]["id"])))
    checks = [
        (e("id").isNull(), "event id must be text"),
        (e("index").isNull(), "index must be an integer"),
        (e("type.name").isNull() | kind.isNull(), "unknown event type"),
        (e("team.id").isNull() | e("team.name").isNull(), "team must have an id and a name"),
        (K.clock_problem("e.period", "e.minute", "e.second").isNotNull(), "invalid match clock"),
        (K.timestamp_seconds("e.timestamp").isNull(), "invalid timestamp"),
        (e("location").isNotNull() & ~_size_is(e("location"), 2), "location must be two numbers"),
        (kind.isin("pass", "carry") & e("location").isNull(), "movement without a location"),
        ((kind == "pass") & ~_size_is(e("pass.end_location"), 2), "pass end must be two numbers"),
        ((kind == "carry") & ~_size_is(e("carry.end_location"), 2), "carry end must be two numbers"),
        (
            e("pass.type").isNotNull() & ~F.coalesce(e("pass.type.name").isin(*SET_PIECE_PASSES, *OPEN_PASSES), F.lit(False)),
            "unknown pass type",
        ),
        (
            (kind == "shot") & ~F.coalesce(e("shot.type.name").isin("Penalty", *OPEN_SHOTS), F.lit(False)),
            "unknown shot type",
        ),
        ((kind == "shot") & e("shot.outcome.name").isNull(), "shot without an outcome"),
        (e("shot.end_location").isNotNull() & ~_size_is(e("shot.end_location"), 2, 3), "shot end must be two or three numbers"),
        (
            (kind == "substitution") & (e("player.id").isNull() | e("substitution.replacement.id").isNull()),
            "substitution needs both players",
        ),
        (tactics & e("tactics.formation").isNull(), "formation must be a number"),
        (
            tactics & starting & ~F.coalesce((F.size(e("tactics.lineup")) == 11) & (distinct == 11), F.lit(False)),
            "starting lineup must be eleven distinct players",
        ),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))


def checked_events(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("_action", action_type(F.col("e.type.name"))).withColumn("reasons", event_reasons())


def normalize_events(parsed: DataFrame) -> DataFrame:
    """The event spine with pass, carry and shot details on the same row."""
    e = lambda path: F.col(f"e.{path}")
    kind, at = F.col("_action"), lambda path, i: F.get(e(path), F.lit(i))
    is_pass, is_carry, is_shot = (kind == k for k in ("pass", "carry", "shot"))
    true = lambda path: F.coalesce(e(path), F.lit(False))
    open_pass = e("pass.type").isNull() | e("pass.type.name").isin(*OPEN_PASSES)
    end = lambda i: F.when(is_pass, at("pass.end_location", i)).when(is_carry, at("carry.end_location", i))
    own_goal = e("type.name") == "Own Goal For"
    # A typed field cannot tell a null outcome from no outcome; look at the keys only where
    # the text has such a null.
    keys = F.json_object_keys(F.get_json_object("record", "$.pass"))
    null_outcome = F.col("record").rlike(r'"outcome"\s*:\s*null') & F.coalesce(
        F.array_contains(keys, "outcome"), F.lit(False)
    )
    return checked_events(parsed).where(F.size("reasons") == 0).select(
        "match_id",
        e("id").alias("event_id"),
        e("index").alias("sequence"),
        e("period").alias("period"),
        e("minute").alias("minute"),
        e("second").alias("second"),
        K.elapsed_seconds("e.minute", "e.second").alias("elapsed_seconds"),
        K.timestamp_seconds("e.timestamp").alias("period_seconds"),
        e("team.id").alias("team_id"),
        e("team.name").alias("team_name"),
        e("player.id").alias("player_id"),
        e("player.name").alias("player_name"),
        e("position.name").alias("position"),
        kind.alias("event_type"),
        e("type.name").alias("provider_event_type"),
        at("location", 0).alias("x"),
        at("location", 1).alias("y"),
        end(0).alias("end_x"),
        end(1).alias("end_y"),
        # Any recorded outcome, even an unknown one, means not completed.
        F.when(is_pass, e("pass.outcome").isNull() & ~null_outcome).when(is_carry, True).alias("completed"),
        F.when(is_pass, open_pass).when(is_carry, True).when(is_shot, e("shot.type.name") == "Open Play").alias("open_play"),
        F.when(is_pass & ~open_pass, e("pass.type.name")).alias("set_piece_type"),
        e("pass.type.name").alias("pass_type"),
        e("pass.outcome.name").alias("pass_outcome"),
        e("pass.height.name").alias("height"),
        e("pass.recipient.id").alias("recipient_player_id"),
        F.when(is_pass, true("pass.cross")).alias("is_cross"),
        F.when(is_pass, true("pass.shot_assist")).alias("is_shot_assist"),
        F.when(is_pass, true("pass.goal_assist")).alias("is_goal_assist"),
        e("shot.type.name").alias("shot_type"),
        F.when(is_shot, e("shot.type.name") == "Penalty").alias("penalty"),
        e("shot.statsbomb_xg").cast("decimal(18,12)").alias("provider_xg"),
        e("shot.outcome.name").alias("shot_outcome"),
        e("shot.body_part.name").alias("body_part"),
        e("shot.key_pass_id").alias("key_pass_event_id"),
        at("shot.end_location", 0).alias("shot_end_x"),
        at("shot.end_location", 1).alias("shot_end_y"),
        at("shot.end_location", 2).alias("shot_end_z"),
        ((is_shot & (e("shot.outcome.name") == "Goal")) | own_goal).alias("scores_goal"),
        own_goal.alias("own_goal"),
        e("substitution.replacement.id").alias("player_on_id"),
        e("substitution.outcome.name").alias("substitution_reason"),
        e("tactics.formation").alias("formation"),
        e("possession").alias("possession"),
        e("possession_team.id").alias("possession_team_id"),
        true("under_pressure").alias("under_pressure"),
        F.coalesce(
            e("foul_committed.card.name").isin(*CARDS_OFF) | e("bad_behaviour.card.name").isin(*CARDS_OFF), F.lit(False)
        ).alias("sent_off"),
        F.col("record").alias("provider_record"),
    )


EVENT_COLUMNS = [
    "match_id", "event_id", "sequence", "period", "minute", "second", "period_seconds", "team_id", "player_id", "position",
    "event_type", "provider_event_type", "x", "y", "end_x", "end_y", "under_pressure", "possession", "possession_team_id",
]
PASS_COLUMNS = [
    "match_id", "event_id", "recipient_player_id", "completed", "pass_outcome", "pass_type", "set_piece_type", "open_play",
    "height", "is_cross", "is_shot_assist", "is_goal_assist",
]
SHOT_COLUMNS = [
    "match_id", "event_id", "provider_xg", "shot_outcome", "scores_goal", "shot_type", "body_part", "key_pass_event_id",
    "shot_end_x", "shot_end_y", "shot_end_z",
]


def passes(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'pass'").select(*PASS_COLUMNS)


def carries(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'carry'").select("match_id", "event_id")


def shots(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'shot'").select(*SHOT_COLUMNS)


def substitutions(events: DataFrame) -> DataFrame:
    """With the clock of the event, which presence needs."""
    return events.where("event_type = 'substitution'").select(
        "match_id", "event_id", "team_id", F.col("player_id").alias("player_off_id"), "player_on_id",
        F.col("substitution_reason").alias("reason"), "period", "period_seconds",
    )


def formations(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'formation_change'").select(
        "match_id", "event_id", "team_id", "formation",
        F.when(F.col("provider_event_type") == "Starting XI", "starting").otherwise("tactical_shift").alias("kind"),
    )


def goals(events: DataFrame) -> DataFrame:
    """Scoring shots and own goals credited to the team that benefits."""
    return events.where("scores_goal").select(
        "match_id", "event_id", F.col("team_id").alias("scoring_team_id"),
        F.when(F.col("own_goal"), "own_goal").otherwise("shot").alias("kind"),
        (F.col("period") == K.SHOOTOUT_PERIOD).alias("in_shootout"),
    )


def recorded_fact_rows(events: DataFrame) -> DataFrame:
    """Input of ``recorded_facts``."""
    starting = F.col("provider_event_type") == "Starting XI"
    sub = F.col("event_type") == "substitution"
    return events.where("event_type in ('formation_change', 'substitution')").select(
        "match_id", "team_id", "sequence", "event_id", "period", "minute", "second",
        F.when(sub, "substitution").when(starting, "starting").otherwise("tactical_shift").alias("kind"),
        "formation", F.when(sub, F.col("player_id")).alias("player_off_id"), "player_on_id",
    )


# --- lineups ------------------------------------------------------------------------------


def appearances(players: DataFrame) -> DataFrame:
    started = F.exists("p.positions", lambda s: F.coalesce(s["start_reason"] == "Starting XI", F.lit(False)))
    return players.select(
        "match_id", "team_id", "team_name", "p.player_id", "p.player_name", "p.player_nickname", "p.jersey_number",
        F.coalesce(started, F.lit(False)).alias("started"),
    )


def position_spells(players: DataFrame) -> DataFrame:
    rows = players.select("match_id", "team_id", F.col("p.player_id").alias("player_id"), F.posexplode("p.positions").alias("_n", "s"))
    seconds = lambda clock, period: K.continuous_clock_to_period_seconds(clock, period).cast("decimal(8,3)")
    return rows.select(
        "match_id", "team_id", "player_id", (F.col("_n") + 1).alias("spell_number"), "s.position",
        F.col("s.from_period").alias("start_period"), seconds("s.from", "s.from_period").alias("start_seconds"),
        F.col("s.to_period").alias("end_period"), seconds("s.to", "s.to_period").alias("end_seconds"),
        "s.start_reason", "s.end_reason",
        (
            seconds("s.from", "s.from_period").isNull()
            | (F.col("s.to").isNull() != F.col("s.to_period").isNull())
            | (F.col("s.to").isNotNull() & seconds("s.to", "s.to_period").isNull())
        ).alias("invalid"),
    )


def lineup_problems(players: DataFrame, matches: DataFrame) -> DataFrame:
    """Match-level reasons a lineup file cannot be used."""
    teams = players.groupBy("match_id", "team_id").agg(F.lit(1).alias("_one"))
    listed = teams.join(matches.select("match_id", "home_team_id", "away_team_id"), "match_id", "right")
    plays = F.coalesce(F.col("team_id").isin(F.col("home_team_id"), F.col("away_team_id")), F.lit(False))
    per_match = listed.groupBy("match_id").agg(
        F.count_if(plays).alias("_ours"), F.count_if(F.col("team_id").isNotNull() & ~plays).alias("_foreign")
    )
    spells = position_spells(players).where("invalid").select("match_id").distinct()
    return (
        per_match.where("_foreign > 0").select("match_id", F.lit("lineup team does not play the match").alias("reason"))
        .unionByName(per_match.where("_ours <> 2").select("match_id", F.lit("lineups must list both teams").alias("reason")))
        .unionByName(spells.select("match_id", F.lit("invalid position spell").alias("reason")))
    )


# --- rejects ------------------------------------------------------------------------------


def event_rejects(parsed: DataFrame, matches: DataFrame) -> DataFrame:
    """Per match and reason: how many records fail. The reasons are a fixed, short list.

    One pass: each record is parsed once and gives its reasons, its index and its team to one count.
    """
    none = lambda kind: F.lit(None).cast(kind)
    item = lambda kind, reason, number: F.struct(F.lit(kind).alias("kind"), reason.alias("reason"), number.alias("number"))
    items = F.concat(
        F.transform("reasons", lambda r: item("reason", r, none("int"))),
        F.array(item("index", none("string"), F.col("e.index")), item("team", none("string"), F.col("e.team.id"))),
    )
    counted = checked_events(parsed).select("match_id", F.inline(items)).groupBy("match_id", "kind", "reason", "number").agg(F.count("*").alias("_n"))
    team, index = F.col("kind") == "team", F.col("kind") == "index"
    few = counted.groupBy("match_id", "kind", "reason", F.when(team, F.col("number")).alias("_t")).agg(
        F.sum(F.when(index, (F.col("_n") > 1).cast("bigint")).otherwise(F.col("_n"))).alias("_n")
    )
    sides = matches.groupBy("match_id").agg(F.collect_list(F.struct("home_team_id", "away_team_id")).alias("_sides"))
    foreign = F.size(F.filter("_sides", lambda s: (F.col("_t") != s["home_team_id"]) & (F.col("_t") != s["away_team_id"])))
    records = F.when(team, F.col("_n") * F.when(F.col("_sides").isNotNull(), foreign).otherwise(0)).otherwise(F.col("_n"))
    named = F.when(team, "team is not in the match").when(index, "repeated index").otherwise(F.col("reason"))
    found = few.join(sides, "match_id", "left").select("match_id", named.alias("reason"), records.alias("records")).where("records > 0")
    return found.groupBy("match_id", "reason").agg(F.sum("records").alias("records"))


def adapter_rejects(event_problems: DataFrame, lineup_issues: DataFrame) -> DataFrame:
    """One row per failing match with all its reasons."""
    both = event_problems.select("match_id", "reason").unionByName(lineup_issues.select("match_id", "reason"))
    return both.groupBy("match_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), "; ").alias("reasons"))


def accepted(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    return rows.join(rejects.select("match_id"), "match_id", "left_anti")


# --- matches and names --------------------------------------------------------------------


def match_records(index: DataFrame) -> DataFrame:
    blank = lambda path: F.nullif(F.trim(F.col(path)), F.lit(""))
    kept = lambda path: F.when(blank(path).isNotNull(), F.col(path))
    m = lambda path: F.col(f"m.{path}")
    return index.select(
        m("match_id").alias("match_id"),
        m("competition.competition_id").alias("competition_id"),
        m("season.season_id").alias("season_id"),
        m("competition.competition_name").alias("competition_name"),
        m("season.season_name").alias("season_name"),
        m("match_date").try_cast("date").alias("match_date"),
        m("kick_off").alias("kickoff"),
        m("home_team.home_team_id").alias("home_team_id"),
        m("home_team.home_team_name").alias("home_team_name"),
        m("away_team.away_team_id").alias("away_team_id"),
        m("away_team.away_team_name").alias("away_team_name"),
        m("home_score").alias("home_score"),
        m("away_score").alias("away_score"),
        m("match_week").alias("match_week"),
        m("competition_stage.name").alias("stage"),
        m("stadium.name").alias("stadium"),
        *[kept(f"m.metadata.{f}").alias(f) for f in ("data_version", "xy_fidelity_version", "shot_fidelity_version")],
        kept("m.last_updated").alias("provider_last_updated"),
        F.coalesce(m("match_status_360") == "available", F.lit(False)).alias("has_three_sixty"),
        F.get_json_object("record", "$.competition.competition_name").alias("recorded_competition_name"),
    )


def name_dim(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One name per id: the smallest recorded."""
    return rows.groupBy(key).agg(F.min(name).alias(name))


def competition_seasons(splits: DataFrame, ingested: DataFrame) -> DataFrame:
    """Catalog, bucket and ingested counts per season."""
    key = ["competition_id", "season_id"]
    n = lambda b: F.count_if(F.col("bucket") == b).alias(f"{b}_matches")
    catalog = splits.groupBy(*key).agg(
        F.count("*").alias("catalog_matches"), n("development"), n("validation"), n("test")
    )
    taken = ingested.groupBy(*key).agg(F.count("*").alias("ingested_matches"))
    return catalog.join(taken, key)


# When each normalized field becomes known.
HINDSIGHT = {
    "events": ("under_pressure", "possession", "possession_team_id", "provider_record"),
    "passes": ("is_shot_assist", "is_goal_assist"),
    "matches": ("home_score", "away_score"),
    "position_spells": ("end_period", "end_period_seconds"),
}
DELAYED = {"events": ("end_x", "end_y"), "passes": ("recipient_player_id",)}
KNOWN = {
    "events": ("sequence", "period", "period_seconds", "team_id", "player_id", "position", "event_type", "x", "y"),
    "passes": ("completed", "outcome", "pass_type", "set_piece_type", "open_play", "height", "is_cross"),
    "shots": (
        "provider_xg", "outcome", "is_goal", "shot_type", "body_part", "key_pass_event_id", "end_x", "end_y", "end_z",
    ),
    "substitutions": ("player_off_id", "player_on_id", "reason"),
    "formation_changes": ("formation",),
    "goals": ("scoring_team_id",),
}


def field_availability(spark) -> DataFrame:
    rows = [
        (table, field, when)
        for when, tables in (("known_at_event", KNOWN), ("delayed", DELAYED), ("hindsight", HINDSIGHT))
        for table, fields in tables.items()
        for field in fields
    ]
    return spark.createDataFrame(rows, "table_name string, field string, availability string")


def refuse_hindsight(df: DataFrame, table: str = "events") -> DataFrame:
    """Return ``df`` unless it carries a column that is only known afterwards."""
    found = sorted(set(df.columns) & set(HINDSIGHT.get(table, ())))
    if found:
        raise ValueError(f"hindsight columns in a detector input: {', '.join(found)}")
    return df
