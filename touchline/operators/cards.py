"""Card streams, their evidence, their text, and what is visible at a replay position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.clock import clock_text
from touchline.functions.exact import half_up_percent
from touchline.functions.pitch import CHANNELS, channel, is_final_third_entry
from touchline.functions.prefix import join_small
from touchline.operators.detect import is_burst_shot
from touchline.operators.score import score_after

CARD = ["match_id", "team_id", "kind", "sequence"]


def card_stream(shifts: DataFrame, bursts: DataFrame, events: DataFrame, matches: DataFrame) -> DataFrame:
    """Both card kinds in replay order; at one trigger the burst comes first."""
    shared = ["match_id", "team_id", "period", "sequence", "elapsed_seconds", "event_id", "minute", "second"]
    tagged = lambda df, kind, rank, experimental: df.select(
        *shared, F.lit(kind).alias("kind"), F.lit(rank).alias("kind_rank"), F.lit(experimental).alias("experimental")
    )
    cards = tagged(bursts, "burst", 0, True).unionByName(tagged(shifts, "side_shift", 1, False))
    scores = score_after(
        events.select("match_id", "sequence", "period", "team_id", "scores_goal"), matches
    ).select(
        "match_id", "sequence",
        F.col("home_score_after").alias("home_score"), F.col("away_score_after").alias("away_score"),
    )
    return cards.join(scores, ["match_id", "sequence"]).withColumn(
        "card_id", F.concat_ws("-", "kind", F.col("event_id").cast("string"))
    )


def in_replay_order(cards: DataFrame) -> DataFrame:
    return cards.orderBy("match_id", "sequence", "kind_rank")


def evidence(cards: DataFrame, facts: DataFrame, *, window_seconds: int = 600) -> DataFrame:
    """Rows of the prefix behind each card: recent inside the window, else baseline.

    One row per card and fact rather than arrays on the card: a baseline is as long as the
    match before it. A fact repeats once per later card of its team, and the cooldown
    bounds those by the clock.
    """
    c = cards.select(
        "match_id", "team_id", F.col("sequence").alias("card_sequence"), F.col("period").alias("card_period"),
        F.col("elapsed_seconds").alias("card_elapsed"), *([] if "kind" not in cards.columns else ["kind"]),
        *([] if "card_id" not in cards.columns else ["card_id"]),
    )
    recent = (F.col("period") == F.col("card_period")) & (F.col("elapsed_seconds") > F.col("card_elapsed") - window_seconds)
    return (
        join_small(facts, c, ["match_id", "team_id"])
        .where("sequence <= card_sequence")
        .withColumn("role", F.when(recent, "recent").otherwise("baseline"))
        .drop("card_period", "card_elapsed")
    )


def stream_evidence(stream: DataFrame, events: DataFrame, *, window_seconds: int = 600) -> DataFrame:
    """What a viewer shows under a card: recent entries, and for bursts the recent shots."""
    entry, shot = is_final_third_entry(), is_burst_shot()
    facts = events.where(entry | shot).withColumn("is_shot", shot).withColumn("is_entry", entry)
    rows = evidence(stream, facts, window_seconds=window_seconds).where("role = 'recent'")
    moved = F.col("event_type").isin("pass", "carry")
    return rows.where("is_entry or (is_shot and kind = 'burst')").select(
        "match_id", "card_id", "event_id", F.when(F.col("is_shot"), "shot").otherwise("recent").alias("role"),
        "sequence", "period", "minute", "second", "team_id", F.col("event_type").alias("action"),
        F.col("x").alias("start_x"), F.col("y").alias("start_y"),
        F.when(moved, F.col("end_x")).alias("end_x"), F.when(moved, F.col("end_y")).alias("end_y"),
    )


# --- text ---------------------------------------------------------------------------------


def possessive(name: Column) -> Column:
    return F.concat(name, F.when(name.endswith("s"), "'").otherwise("'s"))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


# Fixed value: how an entry's end channel reads in a sentence.
ENDING = {"left": "on the left", "center": "in the center", "right": "on the right"}


def _pick(which: Column, part: str) -> Column:
    return F.coalesce(*[F.when(which == c, F.col(f"{part}_{c}")) for c in CHANNELS])


def side_shift_sentence(name: Column) -> Column:
    """Expects the columns of ``side_shift_cards``."""
    which = F.col("channel")
    recent, baseline = _pick(which, "recent"), _pick(which, "baseline")
    r_total, b_total = F.col("recent_total"), F.col("baseline_total")
    ending = F.coalesce(*[F.when(which == c, text) for c, text in ENDING.items()])
    base = _text(
        "More of ", possessive(name), " final-third entries are ending ", ending, ": ", recent, " of the last ",
        r_total, " (", half_up_percent(recent, r_total), "%), up from ", baseline, " of ", b_total, " (",
        half_up_percent(baseline, b_total), "%) earlier.",
    )
    larger = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"recent_{c}") > recent, F.struct(F.lit(c).alias("c"), F.col(f"recent_{c}").alias("n")))
                for c in CHANNELS
            ]
        )
    )
    one, two = F.get(larger, F.lit(0)), F.get(larger, F.lit(1))
    clause = F.when(
        F.size(larger) == 1, _text(" The ", one["c"], " has more: ", one["n"], ".")
    ).when(
        F.size(larger) == 2,
        _text(" The ", one["c"], " (", one["n"], ") and the ", two["c"], " (", two["n"], ") have more."),
    )
    return F.concat(base, F.coalesce(clause, F.lit("")))


def counted(number: Column, noun: str) -> Column:
    return _text(number, F.when(number == 1, f" {noun}").otherwise(f" {noun}s"))


def burst_sentence(name: Column) -> Column:
    minutes = F.floor(F.col("window_seconds") / 60)
    earlier = F.when(F.col("earlier_shots") == 0, "none").otherwise(F.col("earlier_shots").cast("string"))
    return _text(
        name, ": ", counted(F.col("recent_shots"), "shot"), " in the last ", minutes, " minutes, after ", earlier,
        " in the previous ", F.floor(F.col("earlier_seconds") / 60),
        " minutes of play. Final-third entries in the last ", minutes, " minutes: ", F.col("recent_entries"), ".",
    )


def formation_text(value: Column) -> Column:
    """Digits read with dashes; anything else stays as recorded."""
    return F.when(value.rlike("^[0-9]+$"), F.regexp_replace(value, "(?<=[0-9])(?=[0-9])", "-")).otherwise(value)


def fact_sentence(name: Column, off_name: Column, on_name: Column) -> Column:
    kind = F.col("kind")
    return (
        F.when(kind == "lineup", _text(name, " started in a recorded ", formation_text(F.col("formation")), " shape."))
        .when(kind == "substitution", _text(on_name, " replaced ", off_name, " for ", name, "."))
        .otherwise(
            _text(
                "The recorded formation for ", name, " changed from ", formation_text(F.col("previous_formation")),
                " to ", formation_text(F.col("formation")), ".",
            )
        )
    )


def render_cards(shifts: DataFrame, bursts: DataFrame, facts: DataFrame, teams: DataFrame) -> DataFrame:
    """One sentence per card and fact. ``teams``: team_id, team_name."""
    name = F.col("team_name")
    key = ["match_id", "team_id", "sequence", "event_id"]
    player = lambda c: F.concat(F.lit("Player "), F.col(c).cast("string"))
    parts = [
        (shifts, F.lit("side_shift"), side_shift_sentence(name)),
        (bursts, F.lit("burst"), burst_sentence(name)),
        (facts, F.col("kind"), fact_sentence(name, player("player_off_id"), player("player_on_id"))),
    ]
    out = None
    for df, kind, sentence in parts:
        rows = df.join(teams, "team_id").select(*key, kind.alias("kind"), sentence.alias("sentence"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _padded(text: Column, width: int) -> Column:
    return F.rpad(text, width, " ")


# Tenths t for which the double nearest to (t + 0.5) / 10 rounds up.
ROUNDS_UP = (0, 4, 5, 6, 7)


def tenths(column: str, width: int) -> Column:
    """One decimal place of the exact binary value, as text of at least ``width``."""
    whole = F.floor(F.col(column))
    part = F.col(column) - whole
    low = F.floor(part * 10)
    middle = (low + 0.5) / 10
    up = (part > middle) | ((part == middle) & low.isin(*ROUNDS_UP))
    value = (whole + (low + up.cast("int")) / 10).cast("decimal(9,1)").cast("string")
    return F.lpad(value, F.greatest(F.length(value), F.lit(width)), F.lit(" "))


def signed(number: Column) -> Column:
    return F.when(number >= 0, F.concat(F.lit("+"), number.cast("string"))).otherwise(number.cast("string"))


def _share_cells(part: str, c: str) -> list[Column]:
    n, total = F.col(f"{part}_{c}"), F.col(f"{part}_total")
    return [
        _padded(_text(n, " of ", total), 9),
        _padded(_text(half_up_percent(n, total), "%"), 7),
    ]


def percent_change(c: str) -> Column:
    """Rounded difference of two shares, halves up, from whole numbers."""
    r, rt, b, bt = (F.col(f"{p}_{k}").cast("decimal(18,0)") for p in ("recent", "baseline") for k in (c, "total"))
    top, bottom = r * bt - b * rt, F.nullif(rt * bt, F.lit(0).cast("decimal(36,0)"))
    return F.coalesce(F.floor((200 * top + bottom) / (2 * bottom)), F.lit(0)).cast("bigint")


def clock_line() -> Column:
    return _text("period ", F.col("period"), ", ", clock_text("minute", "second"))


def render_evidence(shifts: DataFrame, events: DataFrame, *, window_seconds: int = 600) -> DataFrame:
    """Lines to check a side-shift card by: channel table, recent entries, baseline by period."""
    key = ["match_id", "team_id", "card_sequence"]
    cards = shifts.withColumn("card_sequence", F.col("sequence"))
    line = lambda section, position, text: F.struct(
        F.lit(section).alias("section"), position.cast("bigint").alias("position"), text.alias("text")
    )
    header = _text("  ", _padded(F.lit("channel"), 8), _padded(F.lit("recent"), 16), _padded(F.lit("baseline"), 16), "change")
    table = [
        line(
            2, F.lit(i),
            _text("  ", _padded(F.lit(c), 8), *_share_cells("recent", c), *_share_cells("baseline", c), signed(percent_change(c)), " points"),
        )
        for i, c in enumerate(CHANNELS)
    ]
    fixed = cards.select(
        *key,
        F.inline(
            F.array(
                line(1, F.lit(0), header), *table,
                line(3, F.lit(0), _text("  recent window entries (period ", F.col("period"), "):")),
                line(5, F.lit(0), F.lit("  baseline entries by period:")),
            )
        ),
    )
    entries = events.where(is_final_third_entry()).withColumn("end_channel", channel("end_y"))
    rows = evidence(shifts, entries, window_seconds=window_seconds)
    at = lambda x, y: _text("(", tenths(x, 5), ", ", tenths(y, 4), ")")
    described = _text(
        "    ", clock_line(), "  ", _padded(F.col("event_type"), 5), "  ", at("x", "y"), " -> ", at("end_x", "end_y"), "  ", F.col("end_channel"),
    )
    recent = rows.where("role = 'recent'").select(
        *key, F.lit(4).alias("section"), F.col("sequence").cast("bigint").alias("position"), described.alias("text")
    )
    n = lambda c: F.count_if(F.col("end_channel") == c)
    counts = _text("    period ", F.col("period"), ": left ", n("left"), ", center ", n("center"), ", right ", n("right"))
    by_period = rows.where("role = 'baseline'").groupBy(*key, "period").agg(counts.alias("text")).select(
        *key, F.lit(6).alias("section"), F.col("period").cast("bigint").alias("position"), "text"
    )
    return fixed.unionByName(recent).unionByName(by_period)


def render_burst_evidence(bursts: DataFrame, events: DataFrame, *, window_seconds: int = 600) -> DataFrame:
    """Lines to check a burst card by: each recent shot with its place, the earlier counts, the recent entries."""
    key = ["match_id", "team_id", "card_sequence"]
    cards = bursts.withColumn("card_sequence", F.col("sequence"))
    line = lambda section, text: F.struct(F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("position"), text.alias("text"))
    earlier = _text(
        "  earlier: ", F.col("earlier_shots"), " shots and ", F.col("earlier_entries"), " final-third entries in ", F.floor("earlier_seconds"), " seconds"
    )
    fixed = cards.select(
        *key,
        F.inline(
            F.array(
                line(1, _text("  recent shots (", F.col("recent_shots"), "):")), line(3, earlier),
                line(4, _text("  recent final-third entries: ", F.col("recent_entries"))),
            )
        ),
    )
    rows = evidence(bursts, events.where(is_burst_shot()), window_seconds=window_seconds).where("role = 'recent'")
    placed = F.when(F.col("x").isNull() | F.col("y").isNull(), "").otherwise(_text("  at (", tenths("x", 5), ", ", tenths("y", 4), ")"))
    shots = rows.select(
        *key, F.lit(2).alias("section"), F.col("sequence").cast("bigint").alias("position"),
        _text("    ", clock_line(), "  ", F.col("event_id"), placed).alias("text"),
    )
    return fixed.unionByName(shots)


def render_fact_evidence(facts: DataFrame, source: str) -> DataFrame:
    """The records behind a fact: the event, and for a change of formation the one before it."""
    named = lambda what, event: _text(f"  {what}: ", F.col(event), f" ({source})")
    change = F.array(named("previous formation event", "previous_event_id"), named("new formation event", "event_id"))
    texts = F.when(F.col("kind") == "formation_change", change).otherwise(F.array(named("recorded event", "event_id")))
    return facts.select("match_id", "team_id", "sequence", "kind", F.posexplode(texts).alias("position", "text"))


# --- replay position ----------------------------------------------------------------------


def timeline(recorded: DataFrame) -> DataFrame:
    """Periods laid end to end. ``recorded`` is the output of ``recorded_periods``."""
    start = F.col("start_minute") * 60 + F.col("start_second")
    length = F.greatest(start, F.col("end_minute") * 60 + F.col("end_second")) - start
    before = Window.partitionBy("match_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    rows = recorded.select("match_id", "period", start.alias("start_seconds"), length.alias("length"))
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _segments(periods: DataFrame) -> DataFrame:
    """One row per match with its periods (at most five) in order."""
    return periods.groupBy("match_id").agg(
        F.sort_array(F.collect_list(F.struct("period", "start_seconds", "length", "offset"))).alias("segments"),
        F.sum("length").alias("total"),
    )


def with_position(items: DataFrame, periods: DataFrame) -> DataFrame:
    """Replay position of each item, clamped to its period or to the timeline."""
    own = F.get(F.filter("segments", lambda s: s["period"] == F.col("period")), F.lit(0))
    into = F.col("minute") * 60 + F.col("second") - own["start_seconds"]
    inside = own["offset"] + F.least(F.greatest(into, F.lit(0)), own["length"])
    outside = F.when(F.col("period") < F.get("segments", F.lit(0))["period"], F.lit(0)).otherwise(F.col("total"))
    return (
        items.join(_segments(periods), "match_id")
        .withColumn("position", F.coalesce(inside, outside).cast("bigint"))
        .drop("segments", "total")
    )


def clock_at(asks: DataFrame, periods: DataFrame) -> DataFrame:
    """The clock at a replay position; a period's last second belongs to it."""
    clamped = F.least(F.greatest("position", F.lit(0)), "total")
    hit = F.get(F.filter("segments", lambda s: F.col("_at") <= s["offset"] + s["length"]), F.lit(0))
    seconds = F.col("_hit.start_seconds") + F.col("_at") - F.col("_hit.offset")
    return (
        asks.join(_segments(periods), "match_id")
        .withColumn("_at", clamped)
        .withColumn("_hit", hit)
        .select(
            *asks.columns, F.col("_hit.period").alias("period"),
            F.floor(seconds / 60).cast("int").alias("minute"), (seconds % 60).cast("int").alias("second"),
        )
    )


def visible_items(items: DataFrame, asks: DataFrame) -> DataFrame:
    """Items reached at each asked position (``asks``: match_id, position)."""
    asked = asks.select("match_id", F.col("position").alias("asked_position"))
    return items.join(asked, "match_id").where("position <= asked_position")


def as_of_snapshot(goals: DataFrame, cards: DataFrame, facts: DataFrame, periods: DataFrame, asks: DataFrame) -> DataFrame:
    """Clock, score and counts of everything visible at each asked position."""
    none = F.lit(None).cast("bigint")
    shape = lambda df, kind, home, away: df.select(
        "match_id", "period", "minute", "second", "sequence", F.lit(kind).alias("item"), home.alias("home"), away.alias("away")
    )
    items = (
        shape(goals, "goal", F.col("home_score"), F.col("away_score"))
        .unionByName(shape(cards, "card", none, none))
        .unionByName(shape(facts, "fact", none, none))
    )
    seen = visible_items(with_position(items, periods), asks)
    goal = F.col("item") == "goal"
    score = F.max_by(F.when(goal, F.struct("home", "away")), F.when(goal, F.col("sequence")))
    summary = seen.groupBy("match_id", F.col("asked_position").alias("position")).agg(
        score.alias("_score"), *[F.count_if(F.col("item") == k).alias(f"{k}s") for k in ("goal", "card", "fact")]
    )
    zero = F.lit(0)
    return clock_at(asks, periods).join(summary, ["match_id", "position"], "left").select(
        "match_id", "position", "period", "minute", "second",
        F.coalesce("_score.home", zero).alias("home_score"), F.coalesce("_score.away", zero).alias("away_score"),
        *[F.coalesce(f"{k}s", zero).alias(f"{k}s") for k in ("goal", "card", "fact")],
    )


def unread_cards(visible: DataFrame, reads: DataFrame, matches: DataFrame, *, show_experimental: bool = True) -> DataFrame:
    """Per match: off / new / seen, how many are new, and the card a click opens."""
    shown = visible if show_experimental else visible.where("not experimental")
    marked = shown.join(reads.select("card_id", F.lit(True).alias("_read")), "card_id", "left")
    unread = F.col("_read").isNull()
    place = F.struct("sequence", "kind_rank")
    state = marked.groupBy("match_id").agg(
        F.count_if(unread).alias("new_count"),
        F.coalesce(
            F.max_by("card_id", F.when(unread, place)), F.max_by("card_id", place)
        ).alias("opens"),
    )
    return matches.select("match_id").join(state, "match_id", "left").select(
        "match_id",
        F.when(F.col("opens").isNull(), "off").when(F.col("new_count") > 0, "new").otherwise("seen").alias("state"),
        F.coalesce("new_count", F.lit(0)).alias("new_count"),
        "opens",
    )
