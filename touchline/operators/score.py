"""Score and period state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.clock import SHOOTOUT_PERIOD
from touchline.functions.prefix import Running, join_small, running, sequence_block


def team_matches(matches: DataFrame, lineup_problems: DataFrame | None = None) -> DataFrame:
    """One row per team per match. ``lineup_problems`` lists match ids with lineup warnings."""
    sides = F.array(
        *[
            F.struct(
                F.col(f"{own}_team_id").alias("team_id"),
                F.lit(own == "home").alias("is_home"),
                F.col(f"{other}_team_id").alias("opponent_team_id"),
                F.col(f"{own}_score").alias("goals_for"),
                F.col(f"{other}_score").alias("goals_against"),
            )
            for own, other in (("home", "away"), ("away", "home"))
        ]
    )
    kept = [c for c in ("match_id", "competition_id", "season_id", "match_date") if c in matches.columns]
    rows = matches.select(*kept, F.inline(sides))
    if lineup_problems is None:
        return rows.withColumn("lineup_consistent", F.lit(True))
    flagged = lineup_problems.select("match_id").distinct().withColumn("_bad", F.lit(True))
    return rows.join(flagged, "match_id", "left").withColumn(
        "lineup_consistent", F.col("_bad").isNull()
    ).drop("_bad")


def periods(events: DataFrame) -> DataFrame:
    """Period end: the latest recorded end or, if later, the latest clock of any event."""
    recorded = F.max(F.when(F.col("event_type") == "period_end", F.col("period_seconds")))
    zero = F.lit(0).cast("decimal(8,3)")
    return events.groupBy("match_id", "period").agg(
        F.greatest(F.coalesce(recorded, zero), F.max("period_seconds")).alias("end_seconds"),
        (F.first("period") == SHOOTOUT_PERIOD).alias("is_shootout"),
        F.count("*").alias("events"),
    )


def score_measures(exclusive: bool) -> list[Running]:
    """Goals so far of the acting team and of both teams; shootout goals never count.

    No match table is needed for these, so nothing is joined before the ordered pass.
    """
    goal = F.coalesce(F.col("scores_goal") & (F.col("period") != SHOOTOUT_PERIOD), F.lit(False)).cast("int")
    return [Running("_own", "sum", goal, ("team_id",), exclusive), Running("_all", "sum", goal, (), exclusive)]


def with_match_teams(events: DataFrame, matches: DataFrame) -> DataFrame:
    return join_small(events, matches.select("match_id", "home_team_id", "away_team_id"), ["match_id"])


def _both_scores(seen: DataFrame, matches: DataFrame, when: str) -> DataFrame:
    home = F.col("team_id") == F.col("home_team_id")
    other = F.col("_all") - F.col("_own")
    return (
        with_match_teams(seen, matches)
        .withColumn(f"home_score_{when}", F.when(home, F.col("_own")).otherwise(other))
        .withColumn(f"away_score_{when}", F.when(home, other).otherwise(F.col("_own")))
        .drop("_own", "_all", "home_team_id", "away_team_id")
    )


def score_states(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Score before each event. Foreign goals must be ruled out first (``foreign_goals``)."""
    rows = events.select("match_id", "event_id", "sequence", "period", "period_seconds", "team_id", "scores_goal")
    seen = running(rows, ["match_id"], ["sequence"], sequence_block(), score_measures(exclusive=True))
    return _both_scores(seen, matches, "before").drop("team_id", "scores_goal")


def score_after(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Score after each event, as cards show it."""
    seen = running(events, ["match_id"], ["sequence"], sequence_block(), score_measures(exclusive=False))
    return _both_scores(seen, matches, "after")


def foreign_goals(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Goals credited to a team that does not play the match; these must stop a replay."""
    return with_match_teams(events.where("scores_goal"), matches).where(
        (F.col("period") != SHOOTOUT_PERIOD)
        & (F.col("team_id") != F.col("home_team_id"))
        & (F.col("team_id") != F.col("away_team_id"))
    )


def goal_timeline(events: DataFrame, matches: DataFrame) -> DataFrame:
    own_goal = F.col("own_goal") if "own_goal" in events.columns else F.lit(False)
    return (
        score_after(events, matches)
        .where(F.col("scores_goal") & (F.col("period") != SHOOTOUT_PERIOD))
        .select(
            "match_id",
            "event_id",
            "sequence",
            "period",
            "minute",
            "second",
            "team_id",
            own_goal.alias("own_goal"),
            F.coalesce("penalty", F.lit(False)).alias("penalty"),
            F.col("home_score_after").alias("home_score"),
            F.col("away_score_after").alias("away_score"),
        )
    )


def recorded_periods(events: DataFrame) -> DataFrame:
    """First start and last end of each period that has both boundary events."""
    is_start, is_end = (F.col("event_type") == f"period_{b}" for b in ("start", "end"))
    clock = F.struct("minute", "second")
    found = events.where(is_start | is_end).groupBy("match_id", "period").agg(
        F.min_by(F.when(is_start, clock), F.when(is_start, F.col("sequence"))).alias("start"),
        F.max_by(F.when(is_end, clock), F.when(is_end, F.col("sequence"))).alias("end"),
    )
    return found.where("start is not null and end is not null").select(
        "match_id",
        "period",
        F.col("start.minute").alias("start_minute"),
        F.col("start.second").alias("start_second"),
        F.col("end.minute").alias("end_minute"),
        F.col("end.second").alias("end_second"),
    )


def state_name(difference: Column) -> Column:
    return F.when(difference > 0, "leading").when(difference == 0, "level").otherwise("trailing")


def score_state_at_window_start(
    events: DataFrame, matches: DataFrame, *, length: int = 600
) -> DataFrame:
    """Each team's score state at the first event by sequence of each window."""
    firsts = (
        score_states(events, matches)
        .where("period in (1, 2)")
        .groupBy("match_id", "period", F.floor(F.col("period_seconds") / length).cast("int").alias("window_index"))
        .agg(F.min_by(F.struct("home_score_before", "away_score_before"), "sequence").alias("_s"))
    )
    gap = F.col("_s.home_score_before") - F.col("_s.away_score_before")
    own = F.when(F.col("is_home"), gap).otherwise(-gap)
    return firsts.join(team_matches(matches).select("match_id", "team_id", "is_home"), "match_id").select(
        "match_id", "team_id", "period", "window_index", state_name(own).alias("state")
    )
