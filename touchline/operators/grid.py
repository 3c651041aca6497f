"""Gap-free time grids, windows, possessions and team summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch
from touchline.functions.prefix import Running, running
from touchline.operators.context import BIN_SECONDS
from touchline.operators.score import periods, team_matches
from touchline.operators.stats import ratio
from touchline.session import cut_lineage

BIN = ["match_id", "team_id", "period", "time_bin"]
WINDOW = ["match_id", "team_id", "period", "window_index"]
MONEY = "decimal(28,12)"


def count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def time_grid(events: DataFrame, matches: DataFrame, width: int = BIN_SECONDS) -> DataFrame:
    """Every team, regular period and bin, empty ones too; the last bin ends with the period."""
    length = F.col("end_seconds")
    bins = F.sequence(F.lit(0), F.floor(length / width).cast("int"))
    return (
        team_matches(matches)
        .select("match_id", "team_id", "opponent_team_id")
        .join(periods(events).where("not is_shootout").select("match_id", "period", "end_seconds"), "match_id")
        .withColumn("time_bin", F.explode(bins))
        .select(
            *BIN,
            "opponent_team_id",
            (F.col("time_bin") * width).alias("bin_start_seconds"),
            F.when(F.col("time_bin") == F.floor(length / width), length)
            .otherwise((F.col("time_bin") + 1) * width)
            .cast("decimal(10,3)")
            .alias("bin_end_seconds"),
        )
    )


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def tilt_pass() -> Column:
    return _is("pass") & F.col("completed") & F.col("open_play") & (F.col("x") >= pitch.FINAL_THIRD_X)


def bin_counts() -> dict[str, Column]:
    """The filtered counts and sums of one bin, usable in batch and in streams."""
    entry, side = pitch.is_final_third_entry(), pitch.channel("end_y")
    xg = F.coalesce("provider_xg", F.lit(0).cast("decimal(18,12)"))
    return {
        "pass_attempts": count(_is("pass")),
        "completed_passes": count(_is("pass") & F.col("completed")),
        "open_play_passes": count(_is("pass") & F.col("open_play")),
        "set_piece_passes": count(_is("pass") & ~F.col("open_play")),
        "carries": count(_is("carry")),
        "final_third_entries": count(entry),
        "entries_left": count(entry & (side == "left")),
        "entries_center": count(entry & (side == "center")),
        "entries_right": count(entry & (side == "right")),
        "box_entries": count(pitch.is_box_entry()),
        "tilt_passes": count(tilt_pass()),
        "shots": count(_is("shot")),
        "open_play_shots": count(_is("shot") & F.col("open_play")),
        "provider_xg": F.sum(xg),
        "open_play_provider_xg": F.coalesce(
            F.sum(F.when(F.col("open_play"), xg)), F.lit(0).cast(MONEY)
        ),
        "goals": count(F.col("scores_goal")),
        "pressures": count(_is("pressure")),
        "ball_recoveries": count(_is("ball_recovery")),
    }


def team_time_bins(
    context: DataFrame, events: DataFrame, matches: DataFrame, width: int = BIN_SECONDS
) -> DataFrame:
    """Counts per team and bin on the full grid, with the opponent's tilt passes beside them."""
    measures = bin_counts()
    binned = context.withColumn("time_bin", F.floor(F.col("period_seconds") / width).cast("int"))
    counts = binned.groupBy(*BIN).agg(*[value.alias(name) for name, value in measures.items()])
    # The opponent's counts travel with the bin: one exchange by (match, period, bin)
    # instead of a second aggregation.
    grid = time_grid(events, matches, width)
    tilt = counts.select(
        "match_id", F.col("team_id").alias("opponent_team_id"), "period", "time_bin",
        F.col("tilt_passes").alias("_opponent_tilt"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast(MONEY if "xg" in name else "bigint"))
    joined = grid.join(counts, BIN, "left").join(
        tilt, ["match_id", "opponent_team_id", "period", "time_bin"], "left"
    )
    return joined.select(
        *BIN,
        "opponent_team_id",
        "bin_start_seconds",
        "bin_end_seconds",
        (F.col("bin_end_seconds") - F.col("bin_start_seconds")).alias("bin_seconds"),
        *[zero(name).alias(name) for name in measures],
        zero("_opponent_tilt").alias("opponent_tilt_passes"),
        ratio(zero("tilt_passes"), zero("tilt_passes") + zero("_opponent_tilt")).alias("field_tilt"),
    )


ROLLED = ["final_third_entries", "tilt_passes", "opponent_tilt_passes", "shots", "provider_xg"]


def rolling_bins(bins: DataFrame, n: int = 3) -> DataFrame:
    """Rolling sums over ``n`` consecutive bins; a period holds few bins."""
    last = (
        Window.partitionBy("match_id", "team_id", "period").orderBy("time_bin").rowsBetween(-(n - 1), 0)
    )
    sums = bins.select(*BIN, *[F.sum(c).over(last).alias(f"rolling_{c}") for c in ROLLED])
    tilt = F.col("rolling_tilt_passes")
    return sums.withColumn("rolling_tilt", ratio(tilt, tilt + F.col("rolling_opponent_tilt_passes")))


def fixed_windows(
    context: DataFrame, events: DataFrame, matches: DataFrame, length: int = 600
) -> DataFrame:
    """Non-overlapping windows of each half. Zero shots is zero xG; a shot without xG makes it NULL."""
    halves = context.where("period in (1, 2)").withColumn(
        "window_index", F.floor(F.col("period_seconds") / length).cast("int")
    )
    shot = _is("shot")
    counts = halves.groupBy(*WINDOW).agg(
        F.count("*").alias("team_events"),
        count(pitch.is_final_third_entry()).alias("final_third_entries"),
        count(tilt_pass()).alias("tilt_passes"),
        count(shot).alias("shots"),
        count(shot & F.col("open_play")).alias("open_play_shots"),
        count(shot & F.col("provider_xg").isNull()).alias("shots_missing_xg"),
        F.sum(F.when(shot, F.col("provider_xg"))).alias("_xg"),
        F.sum(F.when(shot & ~F.col("penalty"), F.col("provider_xg"))).alias("_open_xg"),
        count(F.col("scores_goal")).alias("goals_for"),
    )
    other = counts.select(
        "match_id", F.col("team_id").alias("opponent_team_id"), "period", "window_index",
        F.col("team_events").alias("_o_events"), F.col("tilt_passes").alias("_o_tilt"),
        F.col("goals_for").alias("_o_goals"),
    )
    end = F.col("end_seconds")
    grid = (
        team_matches(matches)
        .select("match_id", "team_id", "opponent_team_id", "competition_id")
        .join(periods(events).where("period in (1, 2)").select("match_id", "period", "end_seconds"), "match_id")
        .withColumn("window_index", F.explode(F.sequence(F.lit(0), F.floor(end / length).cast("int"))))
        .where(F.col("window_index") * length < end)
    )
    joined = grid.join(counts, WINDOW, "left").join(
        other, ["match_id", "opponent_team_id", "period", "window_index"], "left"
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.lit(0).cast(MONEY)
    poisoned = lambda value: F.when(n("shots") == 0, none).when(n("shots_missing_xg") == 0, value)
    return joined.select(
        *WINDOW,
        "competition_id",
        (F.col("window_index") * length).cast("double").alias("start_seconds"),
        F.least((F.col("window_index") + 1) * length, end).cast("double").alias("end_seconds"),
        ((F.col("window_index") + 1) * length <= end).alias("complete"),
        (n("team_events") + n("_o_events")).alias("match_events"),
        n("final_third_entries").alias("entries"),
        n("tilt_passes").alias("tilt_passes"),
        n("_o_tilt").alias("opponent_tilt_passes"),
        n("shots").alias("shots"),
        n("open_play_shots").alias("open_play_shots"),
        n("shots_missing_xg").alias("shots_missing_xg"),
        poisoned(F.col("_xg")).alias("xg"),
        poisoned(F.coalesce("_open_xg", none)).alias("non_penalty_xg"),
        n("goals_for").alias("goals_for"),
        n("_o_goals").alias("goals_against"),
    )


def window_pairs(windows: DataFrame) -> DataFrame:
    """Two consecutive complete windows of one team in one half, with their changes."""
    order = Window.partitionBy("match_id", "team_id", "period").orderBy("window_index")
    fields = ["window_index", "entries", "tilt_passes", "opponent_tilt_passes", "shots", "xg", "goals_for", "goals_against"]
    pairs = windows.where("complete").withColumn("before", F.lag(F.struct(*fields)).over(order))
    b = lambda c: F.col(f"before.{c}")
    goals = F.col("goals_for") + F.col("goals_against") + b("goals_for") + b("goals_against")
    before_tilt, after_tilt = b("tilt_passes") + b("opponent_tilt_passes"), F.col("tilt_passes") + F.col("opponent_tilt_passes")
    return pairs.where(b("window_index") == F.col("window_index") - 1).select(
        *WINDOW,
        "competition_id",
        "start_seconds",
        "end_seconds",
        b("entries").alias("entries_before"),
        F.col("entries").alias("entries_after"),
        b("shots").alias("shots_before"),
        F.col("shots").alias("shots_after"),
        F.col("xg").alias("xg_after"),
        (F.col("entries") - b("entries")).alias("entries_change"),
        (F.col("shots") - b("shots")).alias("shots_change"),
        (F.col("xg") - b("xg")).alias("xg_change"),
        before_tilt.alias("tilt_denominator_before"),
        after_tilt.alias("tilt_denominator_after"),
        (ratio(F.col("tilt_passes"), after_tilt) - ratio(b("tilt_passes"), before_tilt)).alias("tilt_change"),
        (goals == 0).alias("goal_free"),
    )


def earlier_window_excess(windows: DataFrame, minimum_prior: int = 2) -> DataFrame:
    """Each complete window minus the mean of all earlier ones of the team in the match."""
    earlier = (
        Window.partitionBy("match_id", "team_id")
        .orderBy("period", "window_index")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    mean = lambda c: F.avg(F.col(c).cast("double")).over(earlier)
    rows = windows.where("complete").withColumns(
        {
            "prior_windows": F.count("*").over(earlier),
            "_missing": F.count_if(F.col("xg").isNull()).over(earlier),
            "entry_excess": F.col("entries") - mean("entries"),
            "shot_excess": F.col("shots") - mean("shots"),
            "xg_excess": F.col("xg").cast("double") - mean("xg"),
        }
    )
    return rows.where(
        (F.col("prior_windows") >= minimum_prior) & (F.col("_missing") == 0) & F.col("xg").isNotNull()
    ).drop("_missing")


def attributed_xg(context: DataFrame, length: int = 600) -> DataFrame:
    """xG of open-play shots after an own entry in the same possession, period and window."""
    key = [*WINDOW, "possession"]
    rows = context.where("period in (1, 2)").withColumn(
        "window_index", F.floor(F.col("period_seconds") / length).cast("int")
    )
    entry = pitch.is_final_third_entry()
    shot = (F.col("event_type") == "shot") & F.col("open_play") & ~F.col("penalty") & F.col("provider_xg").isNotNull()
    # "An earlier entry exists" only needs the first entry of each group.
    first = rows.where(entry).groupBy(*key).agg(F.min("sequence").alias("_first"))
    return (
        rows.where(shot)
        .join(first, key)
        .where("_first < sequence")
        .groupBy(*WINDOW)
        .agg(F.count("*").alias("shots"), F.sum("provider_xg").alias("xg"))
    )


def possessions(context: DataFrame) -> DataFrame:
    """Provider possessions. Needs ``possession_team_id``; measures use that team only."""
    own = F.coalesce(F.col("team_id") == F.col("possession_team_id"), F.lit(False))
    reach = F.greatest(F.col("x"), F.when(F.col("completed"), F.col("end_x")))
    when = lambda c: F.when(own, c)
    place = F.struct("period", "period_seconds")
    owner = F.col("possession_team_id")
    found = (
        context.where("possession is not null")
        .groupBy("match_id", "possession")
        .agg(
            F.min_by(owner, F.when(owner.isNotNull(), F.col("sequence"))).alias("team_id"),
            F.min("sequence").alias("first_sequence"),
            F.max("sequence").alias("last_sequence"),
            F.min_by(place, "sequence").alias("_start"),
            F.max_by(place, "sequence").alias("_end"),
            F.count("*").alias("events"),
            count(own & _is("pass")).alias("pass_attempts"),
            F.max(when(reach)).alias("furthest_x"),
            count(own & _is("shot")).alias("shots"),
            F.coalesce(F.sum(when(F.col("provider_xg"))), F.lit(0).cast(MONEY)).alias("provider_xg"),
            count(F.col("scores_goal")).alias("goals"),
            F.min_by(F.col("score_state"), when(F.col("sequence"))).alias("start_score_state"),
        )
    )
    return found.select(
        "match_id",
        "possession",
        "team_id",
        "first_sequence",
        "last_sequence",
        F.col("_start.period").alias("start_period"),
        F.col("_start.period_seconds").alias("start_seconds"),
        F.col("_end.period").alias("end_period"),
        F.col("_end.period_seconds").alias("end_seconds"),
        F.when(
            F.col("_start.period") == F.col("_end.period"),
            F.col("_end.period_seconds") - F.col("_start.period_seconds"),
        ).alias("duration_seconds"),
        "events",
        "pass_attempts",
        "furthest_x",
        F.coalesce(F.col("furthest_x") >= pitch.FINAL_THIRD_X, F.lit(False)).alias("reached_final_third"),
        "shots",
        "provider_xg",
        "goals",
        "start_score_state",
    )


def team_match_summary(bins: DataFrame, possession_table: DataFrame, matches: DataFrame) -> DataFrame:
    names = [*bin_counts(), "opponent_tilt_passes"]
    totals = bins.groupBy("match_id", "team_id").agg(*[F.sum(c).alias(c) for c in names])
    counted = possession_table.groupBy("match_id", "team_id").agg(F.count("*").alias("_p"))
    tilt = F.col("tilt_passes")
    return (
        team_matches(matches)
        .join(totals, ["match_id", "team_id"])
        .join(counted, ["match_id", "team_id"], "left")
        .select(
            "match_id", "team_id", "is_home", "opponent_team_id", "goals_for", "goals_against", *names,
            ratio(F.col("completed_passes"), F.col("pass_attempts")).alias("pass_completion"),
            ratio(tilt, tilt + F.col("opponent_tilt_passes")).alias("field_tilt"),
            F.coalesce("_p", F.lit(0)).alias("possessions"),
        )
    )


# Days of a block in scans over dates.
DAY_BLOCK = 64


def earlier_order_statistics(points: DataFrame, asks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each ask (``keys``, ``day``, ``spot``, ``k``) the value at rank ``k`` (from 0) among the points of strictly earlier days.

    ``points``: ``keys``, ``day``, ``value`` (whole, not negative), ``n``. All asks search together, one binary digit a round: a
    running count over days of the points in the lower half of an ask's interval says which half holds its rank. A round moves the
    points and the asks once, whatever the number of days or values, and a key's days are scanned in blocks.
    """
    top = points.agg(F.max("value")).first()[0] or 0
    asks = asks.withColumn("found", F.lit(0).cast("bigint"))
    columns = asks.columns
    for digit in range(int(top).bit_length() - 1, -1, -1):
        half = F.call_function("shiftright", "value", F.lit(digit))
        held = points.select(*keys, "day", half.alias("_node"), F.col("n").alias("_w"), F.lit(1).alias("_after")).where("_node % 2 = 0")
        asked = asks.select("*", (F.col("found") * 2).alias("_node"), F.lit(0).cast("bigint").alias("_w"), F.lit(0).alias("_after"))
        both = asked.unionByName(held, allowMissingColumns=True)
        lower = running(both, [*keys, "_node"], ["day", "_after"], F.floor(F.col("day") / DAY_BLOCK), [Running("_lower", "sum", F.col("_w"))])
        up = F.col("k") >= F.col("_lower")
        moved = {"k": F.when(up, F.col("k") - F.col("_lower")).otherwise(F.col("k")).cast("bigint"), "found": F.col("found") * 2 + up.cast("bigint")}
        asks = cut_lineage(lower.where("_after = 0").withColumns(moved).select(*columns))
    return asks


def team_window_distributions(windows: DataFrame, matches: DataFrame, metric: str = "entries") -> DataFrame:
    """Distribution of a count over the windows of the team's strictly earlier matches.

    Windows shrink to a histogram per team, day and value. Sizes and means are sums over earlier days; quantiles come from
    ``earlier_order_statistics``, so neither pairs of matches nor a row per day and value are made.
    """
    day = F.unix_date("match_date").alias("day")
    dated = windows.where(F.col(metric).isNotNull()).join(matches.select("match_id", day), "match_id")
    points = cut_lineage(dated.groupBy("team_id", "day", F.col(metric).cast("bigint").alias("value")).agg(F.count("*").alias("n")))
    played = team_matches(matches).select("match_id", "team_id", day)
    zero = F.lit(0).cast("bigint")
    measured = points.select("team_id", "day", "n", (F.col("n") * F.col("value")).alias("v"))
    daily = measured.unionByName(played.select("team_id", "day", zero.alias("n"), zero.alias("v"))).groupBy("team_id", "day").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    sums = [Running("sample_windows", "sum", F.col("n"), exclusive=True), Running("_sum", "sum", F.col("v"), exclusive=True)]
    before = cut_lineage(running(daily, ["team_id"], ["day"], F.floor(F.col("day") / DAY_BLOCK), sums).drop("n", "v"))
    spots = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    total = F.col("sample_windows")
    ranks = [F.struct(F.lit(s).alias("spot"), F.least(total - 1, F.floor(total * F.lit(f))).cast("bigint").alias("k")) for s, f in spots.items()]
    asks = before.where(total > 0).select("team_id", "day", F.inline(F.array(*ranks)))
    found = earlier_order_statistics(points, asks, ["team_id"])
    wide = found.groupBy("team_id", "day").agg(*[F.max(F.when(F.col("spot") == s, F.col("found"))).alias(s) for s in spots])
    return (
        played.join(before, ["team_id", "day"])
        .join(wide, ["team_id", "day"], "left")
        .select("match_id", "team_id", total.cast("bigint").alias("sample_windows"), ratio(F.col("_sum"), total).alias("mean"), *spots)
    )


def within_match_level(windows: DataFrame) -> DataFrame:
    """Window values centred on the team-match mean."""
    own = Window.partitionBy("match_id", "team_id")
    centred = lambda c: F.col(c).cast("double") - F.avg(F.col(c).cast("double")).over(own)
    return windows.where("complete and xg is not null").select(
        *WINDOW,
        centred("entries").alias("entries_centred"),
        centred("shots").alias("shots_centred"),
        centred("xg").alias("xg_centred"),
    ).withColumn(
        "level",
        F.when(F.round("entries_centred", 9) > 0, "above")
        .when(F.round("entries_centred", 9) < 0, "below")
        .otherwise("equal"),
    )


def level_summary(level: DataFrame) -> DataFrame:
    return level.where("level <> 'equal'").groupBy("level").agg(
        F.count("*").alias("windows"),
        F.avg("shots_centred").alias("mean_shots_vs_own_average"),
        F.avg("xg_centred").alias("mean_xg_vs_own_average"),
    )
