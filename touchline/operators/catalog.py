"""Chosen seasons and the provider's match index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.sources.raw import METADATA_FIELDS

SEASON = ["competition_id", "season_id"]
# Accepted settings of a chosen season.
ROLES = ("core_breadth", "modern_robustness")
COVERAGE = ("complete_season", "single_team", "tournament")
STATUSES_360 = ("available", "scheduled", "processing", "unscheduled")


def season_choices_check(choices: DataFrame) -> DataFrame:
    """Problems of the season choices: unknown settings, bad counts, repeated keys."""
    found = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "unknown role"),
            F.when(~F.coalesce(F.col("coverage").isin(*COVERAGE), F.lit(False)), "unknown coverage"),
            F.when(F.coalesce(F.col("expected_matches") < 1, F.lit(True)), "expected matches must be at least 1"),
            F.when(F.col("known_missing_matches") < 0, "known missing matches must not be negative"),
        )
    )
    repeated = choices.groupBy(*SEASON).agg(F.count("*").alias("n")).where("n > 1")
    return choices.select(*SEASON, F.explode(found).alias("problem")).unionByName(
        repeated.select(*SEASON, F.lit("season chosen twice").alias("problem"))
    )


def indexed(index: DataFrame) -> DataFrame:
    """One row per indexed match with its missing metadata fields and its problem, if any."""
    m = lambda p: F.col(f"m.{p}")
    missing = F.array_compact(
        F.array(*[F.when(F.coalesce(m(f"metadata.{f}"), F.lit("")) == "", f) for f in METADATA_FIELDS])
    )
    status = m("match_status_360")
    problem = (
        F.when(m("match_id").isNull(), "match without an id")
        .when(m("match_date").try_cast("date").isNull(), "invalid match date")
        .when(~F.coalesce(m("kick_off").rlike(r"^\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.lit(False)), "kickoff must be a local time")
        .when(~F.coalesce(m("match_status") == "available", F.lit(False)), "event data is not available")
        .when(status.isNotNull() & ~status.isin(*STATUSES_360), "unknown frame availability")
    )
    return index.select(
        m("match_id").alias("match_id"), m("competition.competition_id").alias("competition_id"),
        m("season.season_id").alias("season_id"),
        F.coalesce(status == "available", F.lit(False)).alias("has_three_sixty"),
        F.array_join(missing, ",").alias("missing_metadata"), problem.alias("problem"),
    )


def catalog_check(index: DataFrame, choices: DataFrame) -> DataFrame:
    """Season-level problems: absent seasons, unchosen ones, wrong counts, repeated or bad matches."""
    rows = indexed(index)
    repeated = rows.groupBy("match_id").agg(F.count("*").alias("n")).where("n > 1").select("match_id", F.lit(True).alias("_again"))
    per_season = rows.join(repeated, "match_id", "left").groupBy(*SEASON).agg(
        F.count("*").alias("matches"),
        F.count_if(F.col("problem").isNotNull()).alias("bad"),
        F.count_if(F.col("_again").isNotNull()).alias("again"),
    )
    both = per_season.join(choices.select(*SEASON, "expected_matches"), SEASON, "full")
    problems = F.array_compact(
        F.array(
            F.when(F.col("matches").isNull(), F.lit("season is absent from the index")),
            F.when(F.col("expected_matches").isNull(), F.lit("match belongs to a season that was not chosen")),
            F.when(
                F.col("matches") != F.col("expected_matches"),
                F.concat(F.lit("expected "), F.col("expected_matches").cast("string"), F.lit(" matches, got "), F.col("matches").cast("string")),
            ),
            F.when(F.col("again") > 0, F.concat(F.col("again").cast("string"), F.lit(" rows repeat a match id"))),
            F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" unusable matches"))),
        )
    )
    return both.select(*SEASON, F.explode(problems).alias("problem"))


def catalog_season_summary(index: DataFrame, choices: DataFrame) -> DataFrame:
    rows = indexed(index).groupBy(*SEASON).agg(
        F.count("*").alias("matches"), F.count_if("has_three_sixty").alias("with_frames"),
        F.count_if(F.col("missing_metadata") != "").alias("missing_metadata"),
    )
    return choices.select(*SEASON, "role", "coverage", "expected_matches", "known_missing_matches").join(rows, SEASON, "left").select(
        *SEASON, "role", "coverage", F.coalesce("matches", F.lit(0)).alias("matches"),
        F.coalesce("with_frames", F.lit(0)).alias("with_frames"), F.coalesce("missing_metadata", F.lit(0)).alias("missing_metadata"),
        (F.col("expected_matches") - F.coalesce("matches", F.lit(0))).alias("gap"), "known_missing_matches",
    )
