"""Quality checks per match. Output: match_id, check_name, severity, passed, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.clock import PERIOD_START_MINUTES
from touchline.functions.pitch import LENGTH, WIDTH
from touchline.functions.prefix import Running, running, sequence_block
from touchline.operators.presence import key_of

BLOCKING, WARNING = "blocking", "warning"


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def check(rows: DataFrame, name: str, severity: str, passed: Column, detail: Column) -> DataFrame:
    return rows.select(
        "match_id", F.lit(name).alias("check_name"), F.lit(severity).alias("severity"),
        F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail"),
    )


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def counted_check(
    matches: DataFrame, problems: DataFrame, count: str, name: str, severity: str, wording: str
) -> DataFrame:
    """Passes when a match has no row in ``problems`` or a zero count there."""
    rows = matches.select("match_id").join(problems, "match_id", "left")
    return check(rows, name, severity, zero(count) == 0, text(zero(count), wording))


def event_facts(events: DataFrame, matches: DataFrame) -> DataFrame:
    outside = lambda c, high: ~F.coalesce(F.col(c).between(0, high), F.lit(True))
    off = outside("x", LENGTH) | outside("y", WIDTH) | outside("end_x", LENGTH) | outside("end_y", WIDTH)
    # Sequences repeat rarely: counting them per sequence first keeps the distinct count
    # parallel inside one match.
    teams = F.array(*[F.col(f"{s}_team_id") for s in ("home", "away")])
    per_sequence = events.groupBy("match_id", "sequence").agg(
        F.count("*").alias("n"), F.count_if(off).alias("off")
    )
    per_match = per_sequence.groupBy("match_id").agg(
        F.sum("n").alias("event_count"), F.count("*").alias("distinct_sequences"),
        F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"),
        F.sum("off").alias("off_pitch"),
    )
    seen = events.groupBy("match_id", "team_id").agg(F.lit(1).alias("_one")).groupBy("match_id").agg(
        F.count("team_id").alias("team_count"), F.collect_set("team_id").alias("_seen")
    )
    return (
        per_match.join(seen, "match_id")
        .join(matches.select("match_id", "home_team_id", "away_team_id"), "match_id")
        .select(
            *per_match.columns, "team_count",
            F.array_contains("_seen", teams[0]).alias("home_seen"), F.array_contains("_seen", teams[1]).alias("away_seen"),
        )
    )


def facts_checks(matches: DataFrame, facts: DataFrame, minimum_events: int = 1000) -> DataFrame:
    rows = matches.select("match_id").join(facts, "match_id", "left")
    no = F.lit(False)
    seen = lambda c: F.coalesce(F.col(c), no)
    n = zero("event_count")
    contiguous = (
        (F.col("first_sequence") == 1) & (F.col("last_sequence") == F.col("event_count"))
        & (F.col("distinct_sequences") == F.col("event_count"))
    )
    return (
        check(
            rows, "teams_present", BLOCKING, (F.col("team_count") == 2) & F.col("home_seen") & F.col("away_seen"),
            text(zero("team_count"), " teams on events; home seen ", seen("home_seen"), ", away seen ", seen("away_seen")),
        )
        .unionByName(
            check(rows, "event_count_plausible", BLOCKING, n >= minimum_events, text(n, f" events (minimum {minimum_events})"))
        )
        .unionByName(
            check(
                rows, "sequence_contiguous", BLOCKING, contiguous,
                text("sequence ", zero("first_sequence"), "..", zero("last_sequence"), " over ", n, " events (", zero("distinct_sequences"), " distinct)"),
            )
        )
        .unionByName(
            check(
                rows, "coordinates_on_pitch", WARNING, zero("off_pitch") == 0,
                text(zero("off_pitch"), " events with a start or end location outside 120 x 80"),
            )
        )
    )


def checksum_check(files: DataFrame) -> DataFrame:
    """``files``: match_id, outcome (see ``verify_contents``)."""
    per_match = files.groupBy("match_id").agg(
        F.count_if(F.col("outcome") != "verified").alias("bad"), F.count("*").alias("files")
    )
    return check(per_match, "raw_checksum", BLOCKING, F.col("bad") == 0, text(F.col("bad"), " of ", F.col("files"), " files not verified"))


def adapter_check(matches: DataFrame, rejects: DataFrame) -> DataFrame:
    rows = matches.select("match_id").join(rejects, "match_id", "left")
    return check(rows, "adapter_validation", BLOCKING, F.col("reasons").isNull(), F.coalesce("reasons", F.lit("accepted")))


def score_check(events: DataFrame, matches: DataFrame) -> DataFrame:
    scored = events.where("scores_goal and period <> 5").groupBy("match_id", "team_id").agg(F.count("*").alias("goals"))
    goal = lambda side: F.coalesce(
        F.sum(F.when(F.col("team_id") == F.col(f"{side}_team_id"), F.col("goals"))), F.lit(0)
    )
    found = matches.select("match_id", "home_team_id", "away_team_id", "home_score", "away_score").join(scored, "match_id", "left")
    derived = found.groupBy("match_id", "home_score", "away_score").agg(goal("home").alias("home"), goal("away").alias("away"))
    return check(
        derived, "score_reconciles", BLOCKING,
        (F.col("home") == F.col("home_score")) & (F.col("away") == F.col("away_score")),
        text("events ", F.col("home"), "-", F.col("away"), ", match index ", F.col("home_score"), "-", F.col("away_score")),
    )


PLAYER = ["match_id", "team_id", "player_id"]


def substitutes_check(matches, substitutions, appearances) -> DataFrame:
    players = substitutions.select("match_id", "team_id", F.explode(F.array("player_off_id", "player_on_id")).alias("player_id"))
    missing = players.join(appearances.select(*PLAYER), PLAYER, "left_anti").groupBy("match_id").agg(F.count("*").alias("players"))
    return counted_check(matches, missing, "players", "substitutes_in_lineup", BLOCKING, " substitution players missing from the team lineup")


def clock_steps(events: DataFrame) -> DataFrame:
    """Each event's step against the latest clock before it in its period."""
    ahead = Running("_ahead", "max", F.col("period_seconds"), ("period",), exclusive=True)
    seen = running(events, ["match_id"], ["sequence"], sequence_block(), [ahead])
    return seen.withColumn("step", F.col("period_seconds") - F.col("_ahead")).drop("_ahead")


def clock_check(matches: DataFrame, events: DataFrame) -> DataFrame:
    back = clock_steps(events).groupBy("match_id").agg(F.count_if(F.col("step") < 0).alias("steps"), F.min("step").alias("largest"))
    rows = matches.select("match_id").join(back, "match_id", "left")
    largest = F.coalesce(-F.least(F.col("largest"), F.lit(0).cast("decimal(8,3)")), F.lit(0).cast("decimal(8,3)"))
    return check(rows, "clock_monotonic", WARNING, zero("steps") == 0, text(zero("steps"), " backward steps; largest ", largest, " s"))


METADATA = ("data_version", "xy_fidelity_version", "shot_fidelity_version")


def metadata_check(matches: DataFrame) -> DataFrame:
    present = F.col(METADATA[0]).isNotNull() & F.col(METADATA[1]).isNotNull() & F.col(METADATA[2]).isNotNull()
    shown = [F.coalesce(c, F.lit("missing")) for c in METADATA]
    return check(
        matches, "provider_metadata_present", WARNING, present,
        text("data ", shown[0], ", xy fidelity ", shown[1], ", shot fidelity ", shown[2]),
    )


def event_players_check(matches, events, appearances) -> DataFrame:
    players = events.where("player_id is not null").groupBy(*PLAYER).agg(F.lit(1).alias("_one"))
    missing = players.join(appearances.select(*PLAYER), PLAYER, "left_anti").groupBy("match_id", "player_id").agg(F.lit(1).alias("_one"))
    return counted_check(
        matches, missing.groupBy("match_id").agg(F.count("*").alias("players")), "players", "event_players_in_lineup", WARNING,
        " event players missing from their team lineup",
    )


def spells_check(matches, spells) -> DataFrame:
    keyed = spells.select(
        "match_id", "player_id", "spell_number",
        key_of("start_period", "start_seconds").alias("start_key"), key_of("end_period", "end_seconds").alias("end_key"),
    )
    following = F.lead("start_key").over(Window.partitionBy("match_id", "player_id").orderBy("start_key", "spell_number"))
    bad = (
        (F.col("end_key") < F.col("start_key")) | (F.col("end_key") > F.col("next"))
        | (F.col("end_key").isNull() & F.col("next").isNotNull())
    )
    found = keyed.withColumn("next", following).where(bad).groupBy("match_id").agg(F.count("*").alias("spells"))
    return counted_check(
        matches, found, "spells", "position_spells_consistent", WARNING, " spells end before they start or overlap a later spell"
    )


def late_spells_check(matches, spells, substitutions, slack: int = 60) -> DataFrame:
    off = substitutions.select("match_id", F.col("player_off_id").alias("player_id"), key_of("period", "period_seconds").alias("off_key"))
    # Only the latest end of a player's spells matters, so each side is one row per player.
    never = F.lit(10**9).cast("decimal(14,3)")
    ends = spells.groupBy("match_id", "player_id").agg(F.max(F.coalesce(key_of("end_period", "end_seconds"), never)).alias("end_key"))
    first = off.groupBy("match_id", "player_id").agg(F.min("off_key").alias("off_key"))
    late = first.join(ends, ["match_id", "player_id"]).where(F.col("end_key") > F.col("off_key") + slack)
    return counted_check(
        matches, late.groupBy("match_id").agg(F.count("*").alias("players")), "players", "substitution_ends_lineup_spell", WARNING,
        " substituted players whose lineup spell runs over a minute past the substitution",
    )


def dq_status(checks: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    return checks.groupBy("match_id").agg(
        F.when(F.bool_or(failed & (F.col("severity") == BLOCKING)), "excluded")
        .when(F.bool_or(failed), "passed_with_warnings")
        .otherwise("passed")
        .alias("dq_status")
    )


def gate(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """Only rows of matches that are not excluded."""
    return rows.join(statuses.where("dq_status <> 'excluded'").select("match_id"), "match_id", "left_semi")


def quality_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check_name", "severity").agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")
    )


def quality_report(checks: DataFrame) -> DataFrame:
    """The report as ordered lines: statuses, one row per check, then every failure."""
    part = lambda df, section, key, line: df.select(F.lit(section).alias("section"), key.alias("key"), line.alias("line"))
    statuses = dq_status(checks).groupBy("dq_status").agg(F.count("*").alias("n"))
    summary = quality_summary(checks)
    failures = checks.where(~F.col("passed"))
    return (
        part(statuses, 1, F.col("dq_status"), text(F.col("dq_status"), ": ", F.col("n")))
        .unionByName(
            part(
                summary, 2, text(F.col("severity"), " ", F.col("check_name")),
                text("| ", F.col("check_name"), " | ", F.col("severity"), " | ", F.col("passed"), " | ", F.col("failed"), " |"),
            )
        )
        .unionByName(
            part(
                failures, 3, text(F.col("severity"), " ", F.col("check_name"), " ", F.col("match_id")),
                text("- ", F.col("match_id"), " `", F.col("check_name"), "` (", F.col("severity"), "): ", F.col("detail")),
            )
        )
    )


# --- profiles over many matches -----------------------------------------------------------


def clock_regression_profile(events: DataFrame, limit: int = 5) -> DataFrame:
    back = clock_steps(events).where("step < 0")
    return back.groupBy("event_type", "period").agg(
        F.count("*").alias("steps"), (-F.max("step")).alias("smallest"), (-F.min("step")).alias("largest")
    ).withColumn("exceeds_limit", F.col("largest") > limit)


def period_offset_check(events: DataFrame) -> DataFrame:
    """Earliest and latest starting minute of each period against the fixed offsets."""
    expected = F.lit(None).cast("int")
    for period, minute in PERIOD_START_MINUTES.items():
        expected = F.when(F.col("period") == period, minute).otherwise(expected)
    return events.where("event_type = 'period_start'").groupBy("period").agg(
        F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute")
    ).withColumn(
        "passed", F.coalesce((F.col("first_minute") == expected) & (F.col("last_minute") == expected), F.lit(False))
    )


def attack_direction_check(events: DataFrame, minimum_mean_x: float = 100) -> DataFrame:
    """Every team and period shoots at the goal at high x."""
    x = F.when(F.col("event_type") == "shot", F.col("x").cast("decimal(18,9)"))
    return events.where("period <> 5").groupBy("match_id", "team_id", "period").agg(
        F.count(x).alias("shots"), F.avg(x).cast("double").alias("mean_x")
    ).withColumn("passed", F.coalesce(F.col("mean_x") > minimum_mean_x, F.lit(False)))


def side_orientation_check(events: DataFrame, sides: DataFrame, before_minute: int = 40) -> DataFrame:
    """Mean y of left and right starters. ``sides``: match_id, player_id, side."""
    y = F.col("y").cast("decimal(18,9)")
    early = events.where((F.col("minute") < before_minute) & F.col("y").isNotNull())
    mean = early.join(sides, ["match_id", "player_id"]).groupBy("match_id", "team_id", "side").agg(
        F.count("*").alias("events"), F.avg(y).cast("double").alias("mean_y")
    )
    left = (F.col("side") == "left") & (F.col("mean_y") < WIDTH / 3)
    right = (F.col("side") == "right") & (F.col("mean_y") > 2 * WIDTH / 3)
    return mean.withColumn("passed", left | right)


def outcome_vocabulary_check(outcomes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Recorded outcomes outside the allowed (event_type, outcome) pairs, with counts."""
    return (
        outcomes.where("outcome is not null")
        .groupBy("event_type", "outcome")
        .agg(F.count("*").alias("events"))
        .join(allowed, ["event_type", "outcome"], "left_anti")
    )
