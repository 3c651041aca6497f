"""Prefix-only detectors: a card may use only events at or before its trigger's sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.pitch import CHANNELS, FINAL_THIRD_X, channel, is_final_third_entry
from touchline.functions.prefix import (
    BLOCK_ROWS,
    Running,
    greedy_cooldown,
    join_per_block,
    join_small,
    prefix_window,
    running,
    sequence_block,
)
from touchline.operators.involvement import involvement

POSITION = ["match_id", "team_id", "period", "sequence", "elapsed_seconds", "event_id"]


def _big(value: Column) -> Column:
    """Counts widened so that products of two counts cannot overflow."""
    return value.cast("decimal(18,0)")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def order_violations(events: DataFrame) -> DataFrame:
    """Sequences that repeat inside a match: replay order would be ambiguous."""
    return (
        events.groupBy("match_id", "sequence")
        .agg(F.count("*").alias("events"))
        .where("events > 1")
    )


def period_starts(events: DataFrame) -> DataFrame:
    """Clock of the first event by sequence of each period."""
    return events.groupBy("match_id", "period").agg(
        F.min_by("elapsed_seconds", "sequence").alias("period_start")
    )


def with_period_start(events: DataFrame, rows: DataFrame) -> DataFrame:
    return join_small(rows, period_starts(events), ["match_id", "period"])


def per_side(events: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per event and team of its match; ``actor_id`` keeps the acting team."""
    teams = events.groupBy("match_id", "team_id").agg(F.lit(1).alias("_one")).drop("_one")
    rows = events if rows is None else rows
    return join_small(rows.withColumnRenamed("team_id", "actor_id"), teams, ["match_id"])


def sides_from_start(events: DataFrame, rows: DataFrame) -> DataFrame:
    """``per_side`` and ``with_period_start`` in one join: rows meet one line per match, period and block of the match.

    ``rows`` should hold only the columns that are needed; they are shuffled once, before they are doubled.
    """
    place = sequence_block().cast("long").alias("_place")
    first = F.struct("sequence", "elapsed_seconds")
    spots = events.where("sequence is not null").groupBy("match_id", "period", place).agg(F.min(first).alias("_first"))
    starts = spots.groupBy("match_id", "period").agg(F.min("_first")["elapsed_seconds"].alias("period_start"))
    teams = events.groupBy("match_id").agg(F.collect_set("team_id").alias("_teams"))
    small = spots.drop("_first").join(starts, ["match_id", "period"]).join(teams, "match_id")
    every = rows.withColumnRenamed("team_id", "actor_id").select("*", place).join(small, ["match_id", "period", "_place"])
    return every.withColumn("team_id", F.explode("_teams")).drop("_place", "_teams")


# --- attacking-side shift -----------------------------------------------------------------


def side_shift_windows(
    events: DataFrame,
    *,
    window_seconds: int = 600,
    fire_on_own_entry: bool = True,
    maximum_seconds_since_own_entry: int | None = None,
    **tuning,
) -> DataFrame:
    """Recent and baseline entry counts per channel at every evaluated trigger."""
    entry = is_final_third_entry()
    full = F.col("elapsed_seconds") - F.col("period_start") >= window_seconds
    own = F.lit(True)
    also: list[Running] = []
    if fire_on_own_entry:
        rows = with_period_start(events, events.where(entry).select(*POSITION, "minute", "second", channel("end_y").alias("_channel")))
    else:
        slim = events.select(*POSITION, "minute", "second", entry.alias("_entry"), F.when(entry, channel("end_y")).alias("_channel"))
        rows = sides_from_start(events, slim)
        own = F.col("_entry") & (F.col("actor_id") == F.col("team_id"))
        last = F.when(F.col("_own"), F.struct("sequence", "period", "elapsed_seconds"))
        also = [Running("last_entry", "max", last, ("team_id",))]
    rows = rows.select(
        *POSITION,
        "minute",
        "second",
        "period_start",
        F.when(own, F.col("_channel")).alias("entry_channel"),
        *([] if fire_on_own_entry else ["actor_id", own.alias("_own")]),
    )
    found = prefix_window(
        rows,
        {c: _flag(F.col("entry_channel") == c) for c in CHANNELS},
        trigger=full,
        window_seconds=window_seconds,
        also=also,
        **tuning,
    )
    if maximum_seconds_since_own_entry is not None:
        last = F.col("last_entry")
        found = found.where(
            (last["period"] == F.col("period"))
            & (F.col("elapsed_seconds") - last["elapsed_seconds"] <= maximum_seconds_since_own_entry)
        )
    return found


def side_shift_candidates(
    events: DataFrame,
    *,
    minimum_recent: int = 8,
    minimum_baseline: int = 12,
    minimum_increase: tuple[int, int] = (1, 4),
    **timing,
) -> DataFrame:
    """Triggers at which one channel's share of entries grew enough (exact fractions)."""
    found = side_shift_windows(events, **timing)
    total = lambda part: sum((F.col(f"{part}_{c}") for c in CHANNELS), F.lit(0))
    recent, baseline = _big(total("recent")), _big(total("earlier"))
    gain = {
        c: _big(F.col(f"recent_{c}")) * baseline - _big(F.col(f"earlier_{c}")) * recent
        for c in CHANNELS
    }
    best = F.array_max(
        F.array(
            *[
                F.struct(gain[c].alias("gain"), F.lit(-i).alias("rank"), F.lit(c).alias("channel"))
                for i, c in enumerate(CHANNELS)
            ]
        )
    )
    n, d = minimum_increase
    enough = (recent >= minimum_recent) & (baseline >= minimum_baseline)
    return (
        found.where(enough)
        .withColumn("_best", best)
        .where(F.lit(d) * F.col("_best.gain") >= F.lit(n) * recent * baseline)
        .select(
            *POSITION,
            "minute",
            "second",
            *([c for c in ("actor_id", "last_entry") if c in found.columns]),
            F.col("_best.channel").alias("channel"),
            *[F.col(f"recent_{c}") for c in CHANNELS],
            *[F.col(f"earlier_{c}").alias(f"baseline_{c}") for c in CHANNELS],
        )
    )


def side_shift_cards(
    events: DataFrame, *, cooldown_seconds: int = 600, source: str = "bridge", **settings
) -> DataFrame:
    """Cards after the per-team cooldown, with the channels whose share fell."""
    cards = greedy_cooldown(side_shift_candidates(events, **settings), cooldown_seconds)
    return with_side_shift_facts(cards).withColumn("sources", F.lit(source))


def with_side_shift_facts(cards: DataFrame) -> DataFrame:
    recent = sum((F.col(f"recent_{c}") for c in CHANNELS), F.lit(0))
    baseline = sum((F.col(f"baseline_{c}") for c in CHANNELS), F.lit(0))
    losing = [
        F.when(
            _big(F.col(f"recent_{c}")) * _big(baseline) < _big(F.col(f"baseline_{c}")) * _big(recent),
            c,
        )
        for c in CHANNELS
    ]
    return cards.withColumns(
        {
            "recent_total": recent,
            "baseline_total": baseline,
            "losing_channels": F.concat_ws(",", *losing),
        }
    )


# The timing variants compared with each other.
VARIANTS = {
    "current": dict(fire_on_own_entry=False),
    "own_entry": dict(fire_on_own_entry=True),
    "own_entry_within_30s": dict(fire_on_own_entry=False, maximum_seconds_since_own_entry=30),
    "own_entry_within_60s": dict(fire_on_own_entry=False, maximum_seconds_since_own_entry=60),
    "own_entry_within_120s": dict(fire_on_own_entry=False, maximum_seconds_since_own_entry=120),
}


def side_shift_variants(
    events: DataFrame, *, cooldown_seconds: int = 600, variants=None, **settings
) -> DataFrame:
    """Cards of every timing variant; the every-event variants share one prefix pass."""
    variants = VARIANTS if variants is None else variants
    keep = [*POSITION, "minute", "second", "actor_id", "channel", "seconds_since_own_entry"]
    keep += [f"{p}_{c}" for p in ("recent", "baseline") for c in CHANNELS]
    every = side_shift_candidates(events, fire_on_own_entry=False, **settings)
    last = F.col("last_entry")
    own_period = last["period"] == F.col("period")
    age = F.when(own_period, F.col("elapsed_seconds") - last["elapsed_seconds"])
    every = every.withColumn("seconds_since_own_entry", age)
    choices = []
    for name, timing in variants.items():
        if timing["fire_on_own_entry"]:
            rule = last["sequence"] == F.col("sequence")
        elif timing.get("maximum_seconds_since_own_entry") is None:
            rule = F.lit(True)
        else:
            rule = age <= timing["maximum_seconds_since_own_entry"]
        choices.append(F.when(rule, F.lit(name)))
    tagged = every.withColumn("variant", F.explode(F.array_compact(F.array(*choices))))
    return greedy_cooldown(
        tagged.select("variant", *keep), cooldown_seconds, ["variant", "match_id", "team_id", "period"]
    )


# --- attacking burst ----------------------------------------------------------------------


def is_burst_shot() -> Column:
    return (F.col("event_type") == "shot") & ~F.coalesce(F.col("penalty"), F.lit(False))


def _periods(events: DataFrame, most: int = 64) -> list[int]:
    """The periods that occur; a handful by nature, so more than ``most`` is taken for a broken feed."""
    found = sorted(r["period"] for r in events.select("period").where("period is not null").distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} different periods")
    return found or [1]


def _period_clock(events: DataFrame, periods: list[int]) -> tuple[DataFrame, list[Running]]:
    """Period starts per match as columns, and the latest clock of each period so far."""
    starts = events.groupBy("match_id").agg(
        *[
            F.min_by(
                F.when(F.col("period") == p, F.col("elapsed_seconds")),
                F.when(F.col("period") == p, F.col("sequence")),
            ).alias(f"start_{p}")
            for p in periods
        ]
    )
    latest = [
        Running(f"latest_{p}", "max", F.when(F.col("period") == p, F.col("elapsed_seconds")))
        for p in periods
    ]
    return starts, latest


def _own_start(periods: list[int]) -> Column:
    return F.coalesce(*[F.when(F.col("period") == p, F.col(f"start_{p}")) for p in periods])


def _earlier_periods(periods: list[int]) -> Column:
    return sum(
        (
            F.when(
                F.col("period") > p,
                F.coalesce(F.col(f"latest_{p}") - F.col(f"start_{p}"), F.lit(0)),
            ).otherwise(0)
            for p in periods[:-1]
        ),
        F.lit(0),
    )


def earlier_playing_seconds(
    events: DataFrame, *, window_seconds: int = 600, trigger: Column | None = None
) -> DataFrame:
    """Playing time before the recent window, over every period so far."""
    trigger = is_burst_shot() if trigger is None else trigger
    periods = _periods(events)
    starts, latest = _period_clock(events, periods)
    rows = join_small(events, starts, ["match_id"])
    seen = running(rows, ["match_id"], ["sequence"], sequence_block(), latest)
    return seen.where(trigger).select(
        *POSITION,
        (_earlier_periods(periods) + F.col("elapsed_seconds") - window_seconds - _own_start(periods)).alias(
            "earlier_seconds"
        ),
    )


def burst_windows(events: DataFrame, *, window_seconds: int = 600, **tuning) -> DataFrame:
    """Recent and earlier shots and entries, and earlier playing time, at each counted shot."""
    periods = _periods(events)
    starts, latest = _period_clock(events, periods)
    slim = events.select(*POSITION, "minute", "second", _flag(is_burst_shot()).alias("_shot"), _flag(is_final_third_entry()).alias("_entry"))
    rows = join_per_block(slim, starts, ["match_id"]).withColumn("period_start", _own_start(periods))
    found = prefix_window(
        rows,
        {"shots": F.col("_shot"), "entries": F.col("_entry")},
        trigger=(F.col("_shot") == 1)
        & (F.col("elapsed_seconds") - F.col("period_start") >= window_seconds),
        window_seconds=window_seconds,
        also=latest,
        **tuning,
    )
    earlier = _earlier_periods(periods) + F.col("elapsed_seconds") - window_seconds - F.col("period_start")
    return found.select(
        *POSITION,
        "minute",
        "second",
        F.lit(window_seconds).alias("window_seconds"),
        earlier.alias("earlier_seconds"),
        "recent_shots",
        "earlier_shots",
        "recent_entries",
        "earlier_entries",
    )


def burst_rule(minimum_shots: Column, ratio_n: Column, ratio_d: Column, minimum_earlier: Column):
    """Recent rate at least ``ratio`` times the earlier rate, in integers."""
    recent, earlier = _big(F.col("recent_shots")), _big(F.col("earlier_shots"))
    return (
        (F.col("earlier_seconds") >= minimum_earlier)
        & (F.col("recent_shots") >= minimum_shots)
        & (
            ratio_d * recent * F.col("earlier_seconds")
            >= ratio_n * earlier * F.col("window_seconds")
        )
    )


def burst_candidates(
    events: DataFrame,
    *,
    minimum_recent_shots: int = 4,
    minimum_ratio: tuple[int, int] = (3, 1),
    minimum_earlier_seconds: int = 600,
    **tuning,
) -> DataFrame:
    n, d = minimum_ratio
    return burst_windows(events, **tuning).where(
        burst_rule(
            F.lit(minimum_recent_shots), F.lit(n), F.lit(d), F.lit(minimum_earlier_seconds)
        )
    )


def burst_cards(events: DataFrame, *, cooldown_seconds: int = 600, **settings) -> DataFrame:
    return greedy_cooldown(burst_candidates(events, **settings), cooldown_seconds)


# --- recorded facts -----------------------------------------------------------------------


def recorded_facts(facts: DataFrame) -> DataFrame:
    """Starting lineups, substitutions, and formations that differ from the previous record.

    ``facts``: match_id, team_id, sequence, event_id, period, minute, second, kind
    (starting / tactical_shift / substitution), formation, player_off_id, player_on_id.
    """
    formation = F.when(
        F.col("kind") != "substitution", F.struct("sequence", "formation", "event_id")
    )
    seen = running(
        facts,
        ["match_id"],
        ["sequence"],
        sequence_block(),
        [Running("previous", "max", formation, ("team_id",), exclusive=True)],
    )
    shift = F.col("kind") == "tactical_shift"
    changed = F.coalesce(F.col("previous.formation") != F.col("formation"), F.lit(False))
    return seen.where(~shift | changed).select(
        "match_id",
        "team_id",
        "sequence",
        "event_id",
        "period",
        "minute",
        "second",
        F.when(F.col("kind") == "starting", "lineup")
        .when(shift, "formation_change")
        .otherwise("substitution")
        .alias("kind"),
        "formation",
        F.when(shift, F.col("previous.formation")).alias("previous_formation"),
        F.when(shift, F.col("previous.event_id")).alias("previous_event_id"),
        "player_off_id",
        "player_on_id",
    )


# --- chance quality against the score -----------------------------------------------------


def chance_quality_moments(events: DataFrame, *, own_goal: Column | None = None) -> DataFrame:
    """Cumulative chances of both sides after each shot or own goal, seen from each side."""
    own_goal = F.lit(False) if own_goal is None else own_goal
    shot = F.col("event_type") == "shot"
    changes = events.where((F.col("period") < 5) & (shot | own_goal)).select(
        *POSITION,
        "minute",
        "second",
        _flag(shot & ~F.col("penalty")).alias("_open"),
        F.when(shot, F.coalesce("provider_xg", F.lit(0)))
        .otherwise(F.lit(0))
        .cast("decimal(18,12)")
        .alias("_xg"),
        _flag((shot & F.col("scores_goal")) | own_goal).alias("_goal"),
        _flag(shot & F.col("scores_goal") & ~F.col("penalty")).alias("_open_goal"),
    )
    sides = per_side(events, changes)
    own = F.col("actor_id") == F.col("team_id")
    open_xg = F.when(F.col("_open") == 1, F.col("_xg")).otherwise(F.lit(0).cast("decimal(18,12)"))
    zero = F.lit(0)
    measures = [
        Running("xg_for", "sum", F.when(own, open_xg).otherwise(zero), ("team_id",)),
        Running("xg_against", "sum", F.when(own, zero).otherwise(open_xg), ("team_id",)),
        Running("all_xg_for", "sum", F.when(own, F.col("_xg")).otherwise(zero), ("team_id",)),
        Running("all_xg_against", "sum", F.when(own, zero).otherwise(F.col("_xg")), ("team_id",)),
        Running("shots_for", "sum", F.when(own, F.col("_open")).otherwise(0), ("team_id",)),
        Running("shots_against", "sum", F.when(own, 0).otherwise(F.col("_open")), ("team_id",)),
        Running("goals_for", "sum", F.when(own, F.col("_goal")).otherwise(0), ("team_id",)),
        Running("goals_against", "sum", F.when(own, 0).otherwise(F.col("_goal")), ("team_id",)),
        Running("open_goals_against", "sum", F.when(own, 0).otherwise(F.col("_open_goal")), ("team_id",)),
        Running("largest_xg", "max", F.when(own, open_xg), ("team_id",)),
    ]
    return running(sides, ["match_id"], ["sequence"], sequence_block(), measures)


def chance_quality_cards(events: DataFrame, margins=("1.0",), **settings) -> DataFrame:
    """First moment per team and score state with an xG lead of ``margin`` while not ahead."""
    moments = chance_quality_moments(events, **settings)
    gap = F.col("xg_for") - F.col("xg_against")
    asked = F.array(*[F.lit(m).cast("decimal(6,2)") for m in margins])
    rows = (
        moments.where(F.col("goals_for") <= F.col("goals_against"))
        .withColumn("margin", F.explode(F.filter(asked, lambda m: gap >= m)))
        .select(
            "margin",
            *POSITION,
            "minute",
            "second",
            "goals_for",
            "goals_against",
            F.round(F.col("xg_for"), 2).cast("double").alias("xg_for"),
            F.round(F.col("xg_against"), 2).cast("double").alias("xg_against"),
            "shots_for",
            "shots_against",
            F.round(
                F.col("largest_xg").cast("double")
                / F.nullif(F.col("xg_for").cast("double"), F.lit(0.0)),
                9,
            ).alias("largest_shot_share"),
            (F.col("all_xg_for") - F.col("all_xg_against")).cast("double").alias("gap_with_penalties"),
            (F.col("open_goals_against") - F.col("xg_against")).cast("double").alias("opponent_finishing"),
        )
    )
    key = ["margin", "match_id", "team_id", "goals_for", "goals_against"]
    rest = [c for c in rows.columns if c not in key]
    return (
        rows.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), "sequence").alias("_first"))
        .select(*key, "_first.*")
        .select(*rows.columns)
    )


# --- prototypes ---------------------------------------------------------------------------


def _evaluated(events: DataFrame, window_seconds: int) -> Column:
    return (F.col("period") != 5) & (
        F.col("elapsed_seconds") - F.col("period_start") >= window_seconds
    )


PROTOTYPE_COLUMNS = [*POSITION, "minute", "outcome", "recent_value", "recent_base", "earlier_value", "earlier_base"]


def territory_checks(
    events: DataFrame,
    *,
    window_seconds: int = 600,
    minimum_recent: int = 10,
    minimum_baseline: int = 20,
    minimum_share: tuple[int, int] = (65, 100),
    minimum_increase: tuple[int, int] = (20, 100),
    **tuning,
) -> DataFrame:
    """Share of completed open-play passes from the final third, at every event and side."""
    tilt = (
        (F.col("event_type") == "pass")
        & F.col("completed")
        & F.col("open_play")
        & (F.col("x") >= FINAL_THIRD_X)
    )
    rows = sides_from_start(events, events.select(*POSITION, "minute", _flag(tilt).alias("_all"))).select(
        *POSITION,
        "minute",
        "period_start",
        _flag((F.col("_all") == 1) & (F.col("actor_id") == F.col("team_id"))).alias("_own"),
        "_all",
    )
    found = prefix_window(
        rows,
        {"own": F.col("_own"), "all": F.col("_all")},
        trigger=_evaluated(events, window_seconds),
        window_seconds=window_seconds,
        **tuning,
    )
    own_r, all_r = _big(F.col("recent_own")), _big(F.col("recent_all"))
    own_e, all_e = _big(F.col("earlier_own")), _big(F.col("earlier_all"))
    (sn, sd), (dn, dd) = minimum_share, minimum_increase
    enough = (F.col("recent_all") >= minimum_recent) & (F.col("earlier_all") >= minimum_baseline)
    fires = (sd * own_r >= sn * all_r) & (dd * (own_r * all_e - own_e * all_r) >= dn * all_r * all_e)
    return _outcome(found, enough, fires, "own", "all")


def chances_checks(
    events: DataFrame,
    *,
    window_seconds: int = 600,
    minimum_recent: int = 3,
    minimum_ratio: int = 2,
    minimum_baseline_seconds: int = 1200,
    **tuning,
) -> DataFrame:
    """Shot rate of the window against the earlier rate, at every event and side."""
    periods = _periods(events)
    starts, _ = _period_clock(events, periods)
    shot = (F.col("event_type") == "shot") & (F.col("period") != 5)
    rows = join_small(per_side(events), starts, ["match_id"]).select(
        *POSITION,
        "minute",
        _own_start(periods).alias("period_start"),
        *[f"start_{p}" for p in periods],
        _flag(shot & (F.col("actor_id") == F.col("team_id"))).alias("_shot"),
    )
    # Here a period ends at its last clock by sequence, not at its largest one.
    last = [
        Running(
            f"last_{p}", "max", F.when(F.col("period") == p, F.struct("sequence", "elapsed_seconds"))
        )
        for p in periods
    ]
    found = prefix_window(
        rows,
        {"shots": F.col("_shot")},
        trigger=_evaluated(events, window_seconds),
        window_seconds=window_seconds,
        also=last,
        **tuning,
    )
    for p in periods:
        found = found.withColumn(f"latest_{p}", F.col(f"last_{p}.elapsed_seconds"))
    baseline = _earlier_periods(periods) + F.greatest(
        F.lit(0), F.col("elapsed_seconds") - window_seconds - F.col("period_start")
    )
    found = found.withColumns(
        {
            "recent_seconds": F.lit(window_seconds).cast("bigint"),
            "earlier_seconds": baseline.cast("bigint"),
        }
    )
    faster = _big(F.col("recent_shots")) * F.col("earlier_seconds") >= minimum_ratio * _big(
        F.col("earlier_shots")
    ) * F.col("recent_seconds")
    return _outcome(
        found,
        F.col("earlier_seconds") >= minimum_baseline_seconds,
        (F.col("recent_shots") >= minimum_recent) & ((F.col("earlier_shots") == 0) | faster),
        "shots",
        "seconds",
    )


def _outcome(found, enough, fires, value, base) -> DataFrame:
    return found.withColumn(
        "outcome",
        F.when(~enough, "insufficient_data").when(fires, "card").otherwise("no_change"),
    ).select(
        *POSITION,
        "minute",
        "outcome",
        F.col(f"recent_{value}").alias("recent_value"),
        F.col(f"recent_{base}").alias("recent_base"),
        F.col(f"earlier_{value}").alias("earlier_value"),
        F.col(f"earlier_{base}").alias("earlier_base"),
    )


def involvement_checks(
    events: DataFrame,
    changes: DataFrame,
    *,
    window_seconds: int = 600,
    minimum_recent: int = 25,
    minimum_baseline: int = 40,
    minimum_share: tuple[int, int] = (20, 100),
    minimum_increase: tuple[int, int] = (10, 100),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """A player's share of team open-play passes against the earlier share while on.

    ``changes``: match_id, team_id, player_id, sequence, on (see ``on_pitch_by_sequence``).
    The best increase per check wins, ties by player id. Events are dealt to blocks of consecutive positions, where players are
    columns of a matrix: no event becomes a row per squad member, and nothing is compared with every interval of presence.
    """
    passes = (F.col("event_type") == "pass") & F.col("open_play")
    return involvement(
        events, changes, passes, window_seconds=window_seconds, least=(minimum_recent, minimum_baseline),
        share=minimum_share, gain=minimum_increase, size=block_rows,
    )


def checked_cards(checks: DataFrame, *, cooldown_seconds: int = 600) -> DataFrame:
    """Cards of a prototype: its firing checks after the cooldown."""
    return greedy_cooldown(checks.where("outcome = 'card'").drop("outcome"), cooldown_seconds)


def detector_outcomes(checks: DataFrame, *, cooldown_seconds: int = 600) -> DataFrame:
    """Per team-minute: card, no_change or insufficient_data; the last check made counts.

    No check is made while a card's cooldown runs, so minutes inside one have no row.
    """
    cards = checked_cards(checks, cooldown_seconds=cooldown_seconds)
    key = ["match_id", "team_id", "period"]
    # Cards of one team and period are at least a cooldown apart, so this list is short.
    fired = cards.groupBy(*key).agg(
        F.collect_list(F.struct("sequence", "elapsed_seconds")).alias("_fired")
    )
    cooling = F.exists(
        F.coalesce("_fired", F.array().cast("array<struct<sequence:int,elapsed_seconds:int>>")),
        lambda c: (c["sequence"] < F.col("sequence"))
        & (F.col("elapsed_seconds") < c["elapsed_seconds"] + cooldown_seconds),
    )
    return (
        join_small(checks, fired, key, "left")
        .where(~cooling)
        .groupBy(*key, "minute")
        .agg(F.max_by("outcome", "sequence").alias("outcome"))
    )


# --- who is on the pitch, by sequence -----------------------------------------------------


def on_pitch_by_sequence(changes: DataFrame) -> DataFrame:
    """Presence intervals in sequence space from lineup, substitution and dismissal changes.

    ``changes``: match_id, team_id, player_id, sequence, on (boolean). A repeated state is
    ignored; ``off_sequence`` is the first sequence the player is no longer on.
    """
    key = ["match_id", "team_id", "player_id"]
    order = ["sequence", "on"]
    state = running(
        changes,
        ["match_id", "team_id"],
        order,
        sequence_block(),
        [Running("_was", "max", F.struct("sequence", "on"), ("player_id",), exclusive=True)],
    )
    turns = state.where(F.coalesce(F.col("_was.on"), F.lit(False)) != F.col("on")).drop("_was")
    numbered_turns = running(
        turns,
        ["match_id", "team_id"],
        order,
        sequence_block(),
        [Running("_spell", "sum", F.col("on").cast("int"), ("player_id",))],
    )
    return (
        numbered_turns.groupBy(*key, "_spell")
        .agg(
            F.min(F.when(F.col("on"), F.col("sequence"))).alias("on_sequence"),
            F.min(F.when(~F.col("on"), F.col("sequence"))).alias("off_sequence"),
        )
        .select(*key, F.col("_spell").alias("spell_number"), "on_sequence", "off_sequence")
    )
