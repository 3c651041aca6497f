"""The wide event table and what is read straight off it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import pitch
from touchline.functions.prefix import Running, running, sequence_block
from touchline.operators.stats import medians
from touchline.operators.score import score_measures, state_name, team_matches, with_match_teams

BIN_SECONDS = 300


def clock_out_of_order(events: DataFrame) -> DataFrame:
    """Flag events whose clock is behind the running maximum of their period."""
    ahead = Running("_ahead", "max", F.col("period_seconds"), ("period",), exclusive=True)
    seen = running(events, ["match_id"], ["sequence"], sequence_block(), [ahead])
    behind = F.coalesce(F.col("period_seconds") < F.col("_ahead"), F.lit(False))
    return seen.withColumn("clock_out_of_order", behind).drop("_ahead")


def event_context(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Every event with place, zone, openness, completion and the score before it.

    Score and clock flags come from one pass per match; details (pass, shot) already sit on
    the event row, so no join on the event id is needed.
    """
    ahead = Running("_ahead", "max", F.col("period_seconds"), ("period",), exclusive=True)
    passed = running(events, ["match_id"], ["sequence"], sequence_block(), [*score_measures(exclusive=True), ahead])
    seen = with_match_teams(passed, matches)
    home = F.col("team_id") == F.col("home_team_id")
    goals_for, goals_against = F.col("_own"), F.col("_all") - F.col("_own")
    kind = F.col("event_type")
    return seen.where(home | (F.col("team_id") == F.col("away_team_id"))).select(
        "match_id",
        "event_id",
        "sequence",
        "period",
        "period_seconds",
        "elapsed_seconds",
        "minute",
        "second",
        F.floor(F.col("period_seconds") / BIN_SECONDS).cast("int").alias("time_bin"),
        F.coalesce(F.col("period_seconds") < F.col("_ahead"), F.lit(False)).alias("clock_out_of_order"),
        "team_id",
        F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")).alias("opponent_team_id"),
        home.alias("is_home"),
        "player_id",
        "event_type",
        "x",
        "y",
        "end_x",
        "end_y",
        pitch.third("x").alias("third"),
        pitch.channel("y").alias("channel"),
        pitch.zone("x", 20, 5).alias("zone_x"),
        pitch.zone("y", 16, 4).alias("zone_y"),
        pitch.in_box("x", "y").alias("in_box"),
        pitch.third("end_x").alias("end_third"),
        pitch.channel("end_y").alias("end_channel"),
        pitch.in_box("end_x", "end_y").alias("end_in_box"),
        F.when(kind == "pass", F.col("open_play"))
        .when(kind == "carry", True)
        .when(kind == "shot", F.col("open_play"))
        .alias("open_play"),
        F.when(kind == "pass", F.col("completed")).when(kind == "carry", True).alias("completed"),
        F.when(kind == "shot", F.col("penalty")).alias("penalty"),
        "provider_xg",
        (F.coalesce("scores_goal", F.lit(False)) & (F.col("period") != 5)).alias("scores_goal"),
        "possession",
        goals_for.cast("int").alias("goals_for_before"),
        goals_against.cast("int").alias("goals_against_before"),
        (goals_for - goals_against).cast("int").alias("goal_difference_before"),
        state_name(goals_for - goals_against).alias("score_state"),
    )


def final_third_entries(context: DataFrame) -> DataFrame:
    return context.where(pitch.is_final_third_entry())


def box_entries(context: DataFrame) -> DataFrame:
    return context.where(pitch.is_box_entry())


def shot_map(events: DataFrame) -> DataFrame:
    return events.where((F.col("event_type") == "shot") & F.col("x").isNotNull()).select(
        "match_id", "event_id", "team_id", "period", "minute", "x", "y", "provider_xg",
        F.col("scores_goal").alias("is_goal"),
    )


def directness_and_recoveries(
    context: DataFrame, matches: DataFrame, *, minimum_recoveries: int = 10, minimum_moves: int = 100
) -> DataFrame:
    """Per team-match: where balls are won back and how straight the ball is moved.

    Sums of coordinates use exact decimals, so the result does not depend on row order.
    """
    exact = lambda c: c.cast("decimal(18,9)")
    start, end = pitch.on_pitch("x", "y"), pitch.on_pitch("end_x", "end_y")
    recovery = F.col("event_type") == "ball_recovery"
    move = pitch.is_move()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    forward = exact(F.greatest(F.col("end_x") - F.col("x"), F.lit(0.0)))
    length = exact(F.hypot(F.col("end_x") - F.col("x"), F.col("end_y") - F.col("y")))
    rows = context.where("period between 1 and 4")
    measured = rows.groupBy("match_id", "team_id").agg(
        count(recovery).alias("recovery_events"),
        count(recovery & start).alias("valid_recoveries"),
        count(recovery & start & (F.col("x") >= 80)).alias("attacking_third_recoveries"),
        count(move).alias("completed_open_play_moves"),
        count(move & start & end).alias("valid_moves"),
        F.sum(F.when(move & start & end, forward)).alias("_forward"),
        F.sum(F.when(move & start & end, length)).alias("_length"),
    )
    counts = [
        "recovery_events", "valid_recoveries", "attacking_third_recoveries",
        "completed_open_play_moves", "valid_moves",
    ]
    directness = 100 * F.col("_forward").cast("double") / F.nullif(F.col("_length").cast("double"), F.lit(0.0))
    middle = medians(rows.where(recovery & start), "x", ["match_id", "team_id"]).withColumnRenamed("median", "median_recovery_x")
    full = team_matches(matches).select("match_id", "team_id")
    for part in (measured, middle):
        full = full.join(part, ["match_id", "team_id"], "left")
    return full.select(
        "match_id",
        "team_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        "median_recovery_x",
        directness.alias("directness"),
    ).withColumn(
        "qualified",
        (F.col("valid_recoveries") >= minimum_recoveries) & (F.col("valid_moves") >= minimum_moves),
    )


def directness_summary(metrics: DataFrame) -> DataFrame:
    q = F.col("qualified")
    share = F.col("attacking_third_recoveries") / F.nullif(F.col("valid_recoveries"), F.lit(0))
    names = {"recovery_x": F.col("median_recovery_x"), "directness": F.col("directness"), "attacking_share": share}
    rows = metrics.withColumns({f"_{n}": F.round(F.when(q, v), 9) for n, v in names.items()})
    out = rows.agg(
        F.count("*").alias("team_matches"),
        F.count_if(q).alias("qualified_team_matches"),
        F.sum("recovery_events").alias("recovery_events"),
        F.sum(F.col("recovery_events") - F.col("valid_recoveries")).alias("invalid_recoveries"),
        F.sum("completed_open_play_moves").alias("completed_open_play_moves"),
        F.sum(F.col("completed_open_play_moves") - F.col("valid_moves")).alias("invalid_moves"),
        *[f(f"_{n}").alias(f"{n}_{label}") for n in names for f, label in ((F.min, "minimum"), (F.max, "maximum"))],
    ).withColumn("_k", F.lit(0))
    for n in names:
        middle = medians(rows, f"_{n}").select(F.lit(0).alias("_k"), F.col("median").alias(f"{n}_median"))
        out = out.join(middle, "_k", "left")
    return out.drop("_k")
