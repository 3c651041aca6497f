"""Audits and comparisons of cards: integrity, persistence, variants, sweeps, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.exact import text_hash
from touchline.functions.pitch import CHANNELS, channel, is_final_third_entry
from touchline.functions.prefix import Running, greedy_cooldown, join_small, numbered, running, sequence_block, with_value_blocks
from touchline.operators.cards import evidence
from touchline.operators.detect import _big, burst_rule, burst_windows, is_burst_shot, period_starts
from touchline.session import cut_lineage

CARD = ["match_id", "team_id", "card_sequence"]


def entries_of(events: DataFrame) -> DataFrame:
    return events.where(is_final_third_entry()).withColumn("channel", channel("end_y"))


def _named(prefix: str) -> Column:
    return F.coalesce(*[F.when(F.col("channel") == c, F.col(f"{prefix}_{c}")) for c in CHANNELS])


def _total(prefix: str) -> Column:
    return sum((F.col(f"{prefix}_{c}") for c in CHANNELS), F.lit(0))


def _most(prefix: str) -> Column:
    return F.greatest(*[F.col(f"{prefix}_{c}") for c in CHANNELS])


def card_audit(cards: DataFrame, card_evidence: DataFrame) -> DataFrame:
    """Per card: is its evidence sound, and what is unusual about it.

    ``card_evidence``: match_id, team_id, card_sequence, event_id, role, sequence and
    ``evidence_team_id``. One (card, event) pair counted twice is a repeat or an overlap.
    """
    per_event = card_evidence.groupBy(*CARD, "event_id").agg(
        F.count_if(F.col("role") == "recent").alias("r"), F.count_if(F.col("role") == "baseline").alias("b"),
        F.max(F.col("sequence") > F.col("card_sequence")).alias("future"),
        F.max(F.col("evidence_team_id") != F.col("team_id")).alias("foreign"),
    )
    checked = per_event.groupBy(*CARD).agg(
        F.count_if((F.col("r") > 1) | (F.col("b") > 1)).alias("repeated"),
        F.count_if((F.col("r") > 0) & (F.col("b") > 0)).alias("overlapping"),
        F.count_if("future").alias("future"), F.count_if("foreign").alias("foreign"),
        F.sum("r").alias("recent_found"), F.sum("b").alias("baseline_found"),
    )
    # Cards of one team and match are few (the cooldown), so this window is small.
    again = Window.partitionBy("match_id", "team_id", "channel").orderBy("sequence")
    rows = cards.withColumn("repeats_channel", F.row_number().over(again) > 1).withColumn("card_sequence", F.col("sequence"))
    n = lambda c: F.coalesce(c, F.lit(0))
    sound = (
        (n("repeated") == 0) & (n("overlapping") == 0) & (n("future") == 0) & (n("foreign") == 0)
        & (n("recent_found") == _total("recent")) & (n("baseline_found") == _total("baseline"))
    )
    return rows.join(checked, CARD, "left").select(
        *CARD, "channel", sound.alias("sound"),
        (F.col("actor_id") != F.col("team_id")).alias("other_team_trigger"),
        (_total("recent") <= 10).alias("at_most_ten_recent"),
        (_named("recent") < _most("recent")).alias("not_plurality"),
        "repeats_channel",
    )


def card_audit_summary(audit: DataFrame) -> DataFrame:
    flags = ["sound", "other_team_trigger", "at_most_ten_recent", "not_plurality", "repeats_channel"]
    return audit.groupBy("channel").agg(F.count("*").alias("cards"), *[F.count_if(f).alias(f) for f in flags])


def card_persistence(
    cards: DataFrame, entries: DataFrame, *, seconds: int = 600, minimum_later: int = 8, increase: tuple[int, int] = (1, 4)
) -> DataFrame:
    """Do later entries of the period keep the card's channel?

    Every fact meets only the cards of its team and period, at most one per cooldown.
    """
    n, d = increase
    c = cards.withColumn("card_sequence", F.col("sequence")).withColumn("card_elapsed", F.col("elapsed_seconds"))
    counts = [f"{p}_{k}" for p in ("recent", "baseline") for k in CHANNELS]
    later = entries.select(
        "match_id", "team_id", "period", "sequence", F.col("elapsed_seconds").alias("e"), F.col("channel").alias("c")
    )
    c = c.select(*CARD, "period", "card_elapsed", "channel", *counts)
    key = ["match_id", "team_id", "period"]
    following = join_small(later, c.select(*key, "card_sequence", "card_elapsed", "channel"), key).where(
        (F.col("sequence") > F.col("card_sequence")) & (F.col("e") > F.col("card_elapsed")) & (F.col("e") <= F.col("card_elapsed") + seconds)
    )
    found = following.groupBy(*CARD).agg(F.count("*").alias("later"), F.count_if(F.col("c") == F.col("channel")).alias("later_named"))
    rows = c.join(found, CARD, "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("later", "later_named")})
    later_named, total = _big(F.col("later_named")), _big(F.col("later"))
    base, base_total = _big(_named("baseline")), _big(_total("baseline"))
    recent, recent_total = _big(_named("recent")), _big(_total("recent"))
    eligible = F.col("later") >= minimum_later
    kept = d * (later_named * base_total - base * total) >= n * total * base_total
    return rows.select(
        *CARD, "channel", "later", "later_named", eligible.alias("eligible"),
        F.when(eligible, kept).alias("sustained"),
        F.when(eligible, later_named * recent_total >= recent * total).alias("at_least_recent"),
    )


def independent_recompute(cards: DataFrame, raw_entries: DataFrame, *, window_seconds: int = 600) -> DataFrame:
    """Card counts against counts recomputed from raw records by a plain join."""
    rows = evidence(cards, raw_entries.withColumnRenamed("channel", "entry_channel"), window_seconds=window_seconds)
    again = rows.groupBy(*CARD).agg(
        *[
            F.count_if((F.col("role") == role) & (F.col("entry_channel") == c)).alias(f"raw_{role}_{c}")
            for role in ("recent", "baseline")
            for c in CHANNELS
        ]
    )
    same = F.lit(True)
    for role in ("recent", "baseline"):
        for c in CHANNELS:
            same = same & (F.coalesce(f"raw_{role}_{c}", F.lit(0)) == F.col(f"{role}_{c}"))
    keyed = cards.withColumn("card_sequence", F.col("sequence"))
    return keyed.join(again, CARD, "left").select(*CARD, "channel", same.alias("agrees"))


def events_before(events: DataFrame, cards: DataFrame) -> DataFrame:
    """Period and clock of the event just before each card of its match.

    An event counts for the next card of its block, so rows shrink to one per card and block before they are put in order;
    a match has few cards (the cooldown).
    """
    key, block = ["match_id", "_block"], sequence_block().alias("_block")
    asks = cards.select("match_id", block, "sequence").distinct()
    listed = asks.groupBy(*key).agg(F.sort_array(F.collect_set("sequence")).alias("_asks"))
    slim = events.select("match_id", block, "sequence", F.struct("sequence", "period", "elapsed_seconds").alias("_row"))
    coming = F.get(F.filter("_asks", lambda at: at > F.col("sequence")), F.lit(0))
    latest = slim.join(listed, key, "left").groupBy(*key, coming.alias("_next")).agg(F.max("_row").alias("_row"))
    # Rows without a card to come are last in their block; each card has a row, even as the first event of a block.
    none = F.lit(None).cast(latest.schema["_row"].dataType).alias("_row")
    steps = latest.unionByName(asks.select(*key, F.col("sequence").alias("_next"), none)).groupBy(*key, "_next").agg(F.max("_row").alias("_row"))
    order = Window.partitionBy("match_id").orderBy("_block", F.col("_next").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = steps.withColumn("_row", F.max("_row").over(order)).where("_next is not null")
    return found.select("match_id", F.col("_next").alias("sequence"), F.col("_row.period").alias("prior_period"), F.col("_row.elapsed_seconds").alias("prior"))


def trigger_mechanisms(cards: DataFrame, events: DataFrame, entries: DataFrame, *, seconds: int = 600) -> DataFrame:
    """Why another team's event fired a card: what changed since the event just before it."""
    previous = events_before(events, cards.where("actor_id <> team_id"))
    order = Window.partitionBy("match_id", "team_id").orderBy("sequence")
    rows = (
        cards.withColumn("_last", F.lag(F.struct("period", "elapsed_seconds")).over(order))
        .where("actor_id <> team_id")
        .join(previous, ["match_id", "sequence"], "left")
        .join(period_starts(events), ["match_id", "period"])
        .withColumn("card_sequence", F.col("sequence"))
    )
    now = F.col("elapsed_seconds")
    same = F.coalesce(F.col("prior_period") == F.col("period"), F.lit(False))
    slim = rows.where(same).select(*CARD, "period", F.col("prior").alias("_p"), now.alias("_n"))
    e = entries.select("match_id", "team_id", "period", "sequence", F.col("elapsed_seconds").alias("_e"))
    gone = join_small(e, slim, ["match_id", "team_id", "period"]).where(
        (F.col("sequence") < F.col("card_sequence")) & (F.col("_e") > F.col("_p") - seconds) & (F.col("_e") <= F.col("_n") - seconds)
    )
    expired = gone.groupBy(*CARD).agg(F.lit(True).alias("_expired"))
    no = F.lit(False)
    ended = (F.col("_last.period") == F.col("period")) & (F.col("prior") < F.col("_last.elapsed_seconds") + seconds) & (now >= F.col("_last.elapsed_seconds") + seconds)
    start = F.col("period_start")
    first = (F.col("prior") - start < seconds) & (now - start >= seconds)
    gap = F.col("seconds_since_own_entry")
    return rows.join(expired, CARD, "left").select(
        *CARD, "channel", F.coalesce("_expired", no).alias("entry_expired"),
        F.coalesce(same & ended, no).alias("cooldown_ended"), F.coalesce(same & first, no).alias("first_full_window"),
        F.when(gap.isNull(), "no_current_period_entry")
        .when(gap < 0, "clock_reversed")
        .when(gap <= 30, "up_to_30_seconds")
        .when(gap <= 60, "31_to_60_seconds")
        .when(gap <= 180, "61_to_180_seconds")
        .otherwise("over_180_seconds")
        .alias("gap"),
    )


def variant_pairing(current: DataFrame, variant: DataFrame, *, tolerance: int = 600) -> DataFrame:
    """One-to-one pairs of cards of the same moment, nearest in time first.

    A team has at most one card per cooldown in a period, so one group of cards is short
    and its pairs can be taken greedily inside one row. Unpaired cards stay, with a NULL.
    """
    key = ["match_id", "team_id", "channel", "period"]
    side = lambda df, name: df.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("sequence", "elapsed_seconds"))).alias(name)
    )
    both = side(current, "a").join(side(variant, "b"), key, "full")
    empty = F.expr("cast(array() as array<struct<sequence:int,elapsed_seconds:int>>)")
    both = both.withColumns({c: F.coalesce(c, empty) for c in ("a", "b")})
    distance = lambda x, y: F.abs(y["elapsed_seconds"] - x["elapsed_seconds"])
    options = F.array_sort(
        F.filter(
            F.flatten(
                F.transform(
                    "a",
                    lambda x: F.transform(
                        "b",
                        lambda y: F.struct(
                            distance(x, y).alias("d"), x["sequence"].alias("a"), y["sequence"].alias("b"),
                            (y["elapsed_seconds"] - x["elapsed_seconds"]).alias("delay"),
                        ),
                    ),
                )
            ),
            lambda o: o["d"] <= tolerance,
        )
    )
    nothing = F.expr("cast(array() as array<struct<d:int,a:int,b:int,delay:int>>)")
    taken = F.aggregate(
        "options",
        nothing,
        lambda done, o: F.when(F.exists(done, lambda p: (p["a"] == o["a"]) | (p["b"] == o["b"])), done).otherwise(
            F.concat(done, F.array(o))
        ),
    )
    chosen = both.withColumn("options", options).withColumn("pairs", taken)
    free = lambda cards, field: F.filter(cards, lambda c: ~F.exists("pairs", lambda p: p[field] == c["sequence"]))
    none = F.lit(None).cast("int")
    every = F.concat(
        F.transform("pairs", lambda p: F.struct(F.lit("paired").alias("state"), p["a"].alias("a"), p["b"].alias("b"), p["delay"].alias("delay"))),
        F.transform(free("a", "a"), lambda c: F.struct(F.lit("lost").alias("state"), c["sequence"].alias("a"), none.alias("b"), none.alias("delay"))),
        F.transform(free("b", "b"), lambda c: F.struct(F.lit("new").alias("state"), none.alias("a"), c["sequence"].alias("b"), none.alias("delay"))),
    )
    return chosen.select(*key, F.inline(every)).select(
        *key, "state", F.col("a").alias("current_sequence"), F.col("b").alias("variant_sequence"), "delay"
    )


def pairing_summary(pairs: DataFrame) -> DataFrame:
    delay = F.col("delay")
    return pairs.agg(
        F.count_if(F.col("state") == "paired").alias("paired"), F.count_if(delay == 0).alias("same_second"),
        F.count_if(delay > 0).alias("later"), F.count_if(delay < 0).alias("earlier"),
        F.coalesce(F.median(F.when(delay > 0, delay)), F.lit(0.0)).alias("median_delay_of_later"),
        F.count_if(delay > 120).alias("later_by_over_120"),
        F.count_if(F.col("state") == "lost").alias("lost"), F.count_if(F.col("state") == "new").alias("new"),
    )


# --- coverage and sweeps ------------------------------------------------------------------


def entry_quartiles(events: DataFrame) -> DataFrame:
    """Team-matches with their entries and the quartile of that count (edges at n * k // 4)."""
    per_team = events.groupBy("match_id", "team_id").agg(F.count_if(is_final_third_entry()).alias("entries"))
    # Distinct counts are few; the running total over them is the order statistic.
    tied = per_team.groupBy("entries").agg(F.count("*").alias("n")).withColumn("_k", F.lit(0))
    counted = running(with_value_blocks(tied, ["_k"], "entries"), ["_k"], ["entries"], F.col("_cut"), [Running("upto", "sum", F.col("n"))])
    total = tied.groupBy("_k").agg(F.sum("n").alias("total"))
    edges = counted.join(F.broadcast(total), "_k").groupBy("_k").agg(
        *[
            F.min(F.when(F.col("upto") > F.floor(F.col("total") * k / 4), F.col("entries"))).alias(f"edge{k}")
            for k in (1, 2, 3)
        ]
    )
    # A single row of edges.
    rows = per_team.withColumn("_k", F.lit(0)).join(F.broadcast(edges), "_k")
    above = sum(((F.col("entries") > F.col(f"edge{k}")).cast("int") for k in (1, 2, 3)), F.lit(0))
    return rows.select("match_id", "team_id", "entries", (above + 1).alias("quartile"))


def entry_quartile_coverage(quartiles: DataFrame, cards: DataFrame) -> DataFrame:
    carded = cards.groupBy("match_id", "team_id").agg(F.count("*").alias("c"))
    rows = quartiles.join(carded, ["match_id", "team_id"], "left")
    return rows.groupBy("quartile").agg(
        F.count("*").alias("team_matches"), F.count_if(F.col("c") > 0).alias("with_a_card"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("cards"), F.max("entries").alias("upper_entries"),
    )


# The studied settings: smallest recent shots and rate ratio as a fraction.
GRID = [(shots, n, d) for shots in (3, 4, 5) for n, d in ((1, 1), (3, 2), (2, 1), (3, 1))]


def threshold_cards(windows: DataFrame, grid: Sequence[tuple[int, int, int]] = GRID, *, minimum_earlier: int = 600, cooldown_seconds: int = 600) -> DataFrame:
    """Burst cards of every setting from one prefix pass; settings are data, not plans."""
    settings = F.array(
        *[
            F.struct(F.lit(f"shots>={s},ratio>={n}/{d}").alias("setting"), F.lit(s).alias("s"), F.lit(n).alias("n"), F.lit(d).alias("d"))
            for s, n, d in grid
        ]
    )
    passing = F.filter(
        settings, lambda g: burst_rule(g["s"], g["n"].cast("decimal(6,0)"), g["d"].cast("decimal(6,0)"), F.lit(minimum_earlier))
    )
    found = windows.withColumn("setting", F.explode(F.transform(passing, lambda g: g["setting"])))
    return greedy_cooldown(found, cooldown_seconds, ["setting", "match_id", "team_id", "period"])


def threshold_sweep(cards: DataFrame) -> DataFrame:
    per_team = cards.groupBy("setting", "match_id", "team_id").agg(F.count("*").alias("c"))
    return per_team.groupBy("setting").agg(F.sum("c").alias("cards"), F.count("*").alias("team_matches_with_a_card"))


def null_shot_stream(events: DataFrame, *, seeds: int = 10, seed: int = 20260928) -> DataFrame:
    """The same number of counted shots per team-match, spread evenly over its playing time.

    Each shot of each reference gets a hashed second of the match's play; the result is an
    ordered event stream per (match, team, reference) with the period boundaries in it.
    """
    spans = events.groupBy("match_id", "period").agg(
        F.min_by("elapsed_seconds", "sequence").alias("start"), F.max("elapsed_seconds").alias("end")
    ).where("end > start")
    before = Window.partitionBy("match_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    laid = spans.withColumn("offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0)))
    per_match = laid.groupBy("match_id").agg(
        F.sort_array(F.collect_list(F.struct("period", "start", "end", "offset"))).alias("spans"),
        F.sum(F.col("end") - F.col("start")).alias("play"),
    )
    shots = events.where(is_burst_shot()).select("match_id", "team_id", "event_id", "sequence")
    references = F.explode(F.sequence(F.lit(1), F.lit(seeds)))
    at = text_hash(F.lit(seed), F.col("reference"), F.col("event_id")) % F.col("play")
    placed = (
        join_small(shots, per_match, ["match_id"])
        .withColumn("reference", references)
        .withColumn("at", at)
        .withColumn("span", F.element_at(F.filter("spans", lambda s: s["offset"] <= F.col("at")), -1))
        .select(
            "match_id", "team_id", "reference", "event_id", F.col("span.period").alias("period"),
            (F.col("span.start") + F.col("at") - F.col("span.offset")).cast("int").alias("elapsed_seconds"), F.lit("shot").alias("event_type"),
        )
    )
    teams = shots.groupBy("match_id", "team_id").agg(F.lit(1).alias("_one")).drop("_one")
    edges = (
        teams.join(laid, "match_id")
        .withColumn("reference", references)
        .select(
            "match_id", "team_id", "reference", F.lit(None).cast("bigint").alias("event_id"), "period",
            F.explode(F.array("start", "end")).alias("elapsed_seconds"), F.lit("other").alias("event_type"),
        )
    )
    # Order: clock, then boundaries before shots; one minute of one stream is one block.
    ranked = placed.unionByName(edges).withColumn("_rank", (F.col("event_type") == "shot").cast("int"))
    key = ["match_id", "team_id", "reference"]
    ordered = numbered(
        ranked, key, ["period", "elapsed_seconds", "_rank", "event_id"],
        F.col("period").cast("bigint") * 1_000_000 + F.floor(F.col("elapsed_seconds") / 60), "sequence",
    )
    stream = F.concat_ws("-", *[F.col(c).cast("string") for c in key])
    return ordered.select(
        stream.alias("match_id"), F.col("match_id").alias("of_match"), "reference", "team_id", "period", "sequence",
        "elapsed_seconds", "event_id", F.floor(F.col("elapsed_seconds") / 60).cast("int").alias("minute"),
        (F.col("elapsed_seconds") % 60).alias("second"), "event_type", F.lit(False).alias("penalty"),
        F.lit(False).alias("completed"), F.lit(False).alias("open_play"), F.lit(None).cast("double").alias("x"),
        F.lit(None).cast("double").alias("end_x"),
    )


def null_shot_baseline(events: DataFrame, *, seeds: int = 10, seed: int = 20260928, grid=GRID, **settings) -> DataFrame:
    """Cards per setting: real ones, and the mean over references of evenly spread shots."""
    real = threshold_sweep(threshold_cards(burst_windows(events, **settings), grid))
    # Written once: the windows read the stream several times over.
    stream = cut_lineage(null_shot_stream(events, seeds=seeds, seed=seed))
    reference = threshold_sweep(threshold_cards(burst_windows(stream, **settings), grid))
    return real.select("setting", F.col("cards").alias("real_cards")).join(
        reference.select("setting", (F.col("cards") / seeds).alias("reference_cards")), "setting", "full"
    ).select(
        "setting", F.coalesce("real_cards", F.lit(0)).alias("real_cards"), F.coalesce("reference_cards", F.lit(0.0)).alias("reference_cards")
    )


def stream_density(stream: DataFrame, matches: DataFrame, *, close_seconds: int = 60) -> DataFrame:
    """How many matches have how many cards, close neighbours, and teams with a card."""
    # A match has few cards (one per team, kind and cooldown), so its window is small.
    order = Window.partitionBy("match_id", "period").orderBy("elapsed_seconds", "kind_rank", "team_id")
    near = F.col("elapsed_seconds") - F.lag("elapsed_seconds").over(order) <= close_seconds
    per_match = stream.withColumn("near", F.coalesce(near, F.lit(False))).groupBy("match_id").agg(
        F.count("*").alias("cards"), F.count_if("near").alias("near"), F.size(F.collect_set("team_id")).alias("teams")
    )
    rows = matches.select("match_id").join(per_match, "match_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy(n("cards").alias("cards"), n("teams").alias("teams_with_a_card")).agg(
        F.count("*").alias("matches"), F.sum(n("near")).alias("close_pairs")
    )


def bursts_with_a_goal(bursts: DataFrame, events: DataFrame, *, window_seconds: int = 600) -> DataFrame:
    shots = events.where(is_burst_shot())
    rows = evidence(bursts, shots, window_seconds=window_seconds).where("role = 'recent'")
    per_card = rows.groupBy(*CARD).agg(F.count("*").alias("recent_shots"), F.bool_or("scores_goal").alias("goal"))
    return per_card.groupBy("recent_shots").agg(F.count("*").alias("cards"), F.count_if("goal").alias("with_a_goal"))


# --- chance-quality candidates ------------------------------------------------------------


def candidate_summary(candidates: DataFrame, matches: DataFrame, *, default_margin: float = 1.0) -> DataFrame:
    f, a = F.col("shots_for"), F.col("shots_against")
    better = (a == 0) | (F.col("xg_for") * a >= F.lit(1.5) * F.col("xg_against") * f)
    per_match = candidates.groupBy("margin", "match_id").agg(F.count("*").alias("c")).groupBy("margin").agg(
        F.count("*").alias("matches_with_a_candidate"), F.max("c").alias("most_in_a_match")
    )
    summary = candidates.groupBy("margin").agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("goals_for") < F.col("goals_against")).alias("trailing"),
        F.count_if(F.col("goals_for") == F.col("goals_against")).alias("level"),
        F.median("minute").alias("median_minute"),
        F.count_if(F.col("minute") < 30).alias("before_minute_30"),
        F.count_if(f <= a).alias("not_more_shots"),
        F.count_if(4 * f <= 5 * a).alias("shots_within_25_percent"),
        F.count_if(better).alias("much_better_per_shot"),
        F.count_if(F.col("period") == 1).alias("first_half"),
        F.count_if(F.col("largest_shot_share") > 0.5).alias("one_shot_over_half"),
        F.count_if(F.col("gap_with_penalties") >= default_margin).alias("still_at_margin_with_penalties"),
    )
    total = matches.agg(F.count("*").alias("matches")).withColumn("_k", F.lit(0))
    return summary.join(per_match, "margin").withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").drop("_k")


def moment_category(candidates: DataFrame) -> DataFrame:
    """D, C, B, A in that order, from the shots known at the moment; NULL when none fits."""
    f, a = F.col("shots_for"), F.col("shots_against")
    trailing = F.col("goals_for") < F.col("goals_against")
    return candidates.withColumn(
        "category",
        F.when(trailing & (F.col("opponent_finishing") >= 1.0), "D")
        .when(F.col("largest_shot_share") > 0.5, "C")
        .when((a > 0) & (5 * f >= 4 * a) & (4 * f <= 5 * a), "B")
        .when((a == 0) | (2 * f >= 3 * a), "A"),
    )


def _lottery(seed: int, *columns: str) -> Column:
    return text_hash(F.lit(seed), *[F.col(c) for c in columns])


def stratified_sample(pool: DataFrame, strata: Sequence[tuple[str, Column]], *, seed: int = 20260928) -> DataFrame:
    """One match per stratum by hashed order, none used twice. ``pool``: eligible matches.

    The winner of each stratum is an aggregate; strata are few, and each excludes the
    winners before it.
    """
    chosen = None
    for number, (label, belongs) in enumerate(strata):
        open_pool = pool.where(belongs)
        if chosen is not None:
            open_pool = open_pool.join(chosen.select("match_id"), "match_id", "left_anti")
        lot = F.struct(_lottery(seed + number, "match_id"), F.col("match_id"))
        winner = open_pool.agg(F.min_by("match_id", lot).alias("match_id")).where("match_id is not null").select(
            F.lit(label).alias("stratum"), "match_id"
        )
        chosen = winner if chosen is None else chosen.unionByName(winner)
    return chosen


def category_sample(
    moments: DataFrame, categories: Sequence[str] = ("D", "C", "B", "A"), margins=(1.0, 0.75), *, per_category: int = 3, seed: int = 20260928
) -> DataFrame:
    """A few matches per category from the earliest moment of each, topped up from a lower margin."""
    chosen = None
    for number, label in enumerate(categories):
        taken = None
        for step, margin in enumerate(margins):
            rows = moments.where((F.col("category") == label) & (F.col("margin") == F.lit(margin)))
            for used in (chosen, taken):
                if used is not None:
                    rows = rows.join(used.select("match_id"), "match_id", "left_anti")
            earliest = rows.groupBy("match_id").agg(F.min(F.struct("sequence", "team_id")).alias("_m"))
            lot = _lottery(seed + 10 * number + step, "match_id")
            ranked = earliest.select(
                F.lit(label).alias("category"), F.lit(margin).alias("margin"), "match_id",
                F.col("_m.sequence").alias("sequence"), F.col("_m.team_id").alias("team_id"),
            ).orderBy(lot, "match_id").limit(per_category)
            taken = ranked if taken is None else taken.unionByName(ranked)
        # Higher margins come first; at most margins x per_category rows reach this window.
        place = Window.partitionBy("category").orderBy(F.col("margin").desc(), _lottery(seed, "match_id"), "match_id")
        kept = taken.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= per_category).drop("_n")
        chosen = kept if chosen is None else chosen.unionByName(kept)
    return chosen
