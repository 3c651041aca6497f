"""Replay as a stream: order release, running score and detectors, one state per match."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.functions.pitch import CHANNELS, channel, is_final_third_entry
from touchline.operators.detect import is_burst_shot
from touchline.operators.grid import bin_counts
from touchline.sources.raw import parse_events

OUTPUT = """match_id bigint, kind string, team_id int, period int, sequence int, elapsed_seconds int, event_id string,
home_score int, away_score int, channel string, recent int, earlier int, earlier_seconds int, detail string"""
FIELDS = [part.split()[0] for part in OUTPUT.replace("\n", " ").split(",")]
INPUT = [
    "match_id", "sequence", "event_id", "period", "elapsed_seconds", "team_id", "entry_channel", "burst_shot", "goal_home",
    "goal_away", "fact_kind", "formation",
]


POSITION = ["match_id", "team_id", "period", "sequence", "elapsed_seconds", "event_id"]
WHOLE = ["team_id", "period", "sequence", "elapsed_seconds", "home_score", "away_score", "recent", "earlier", "earlier_seconds"]
FLUSH_ROWS = 10_000


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).reindex(columns=FIELDS).astype({c: "Int32" for c in WHOLE})


def _records(frame: pd.DataFrame) -> Iterator[dict]:
    """Rows as plain Python values, nulls as None; taken column by column."""
    names = list(frame.columns)
    values = [column.astype(object).where(column.notna(), None).tolist() for _, column in frame.items()]
    return (dict(zip(names, row, strict=True)) for row in zip(*values, strict=True))


@dataclass(frozen=True)
class ReplaySettings:
    window_seconds: int = 600
    cooldown_seconds: int = 600
    minimum_recent_entries: int = 8
    minimum_baseline_entries: int = 12
    increase_numerator: int = 1
    increase_denominator: int = 4
    minimum_recent_shots: int = 4
    ratio_numerator: int = 3
    ratio_denominator: int = 1
    minimum_earlier_seconds: int = 600


def read_event_stream(
    spark: SparkSession, path: str, *, lines: bool = True, files_per_batch: int | None = None, bytes_per_batch: int = 256 * 2**20
) -> DataFrame:
    """Event files as they arrive; each record with the match id of its file.

    A batch is bounded by its bytes, so the number of batches follows the data and not how many small files hold it;
    ``files_per_batch`` bounds it by files instead.
    """
    bound = ("maxBytesPerTrigger", bytes_per_batch) if files_per_batch is None else ("maxFilesPerTrigger", files_per_batch)
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true").option(*bound)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(?:match_id=|/)(\d+)(?:/[^/]*|\.json)$", 1).try_cast("bigint")
    text = reader.option("wholetext", not lines).load(path).select(name.alias("match_id"), "value")
    if lines:
        return parse_events(text.withColumnRenamed("value", "record"))
    return parse_events(text.select("match_id", F.explode(F.from_json("value", "array<string>")).alias("record")))


def replay_input(events: DataFrame, home_team: int | None = None) -> DataFrame:
    """The few columns a replay needs. Needs ``home_team_id`` unless a fixed home team is given."""
    home = F.lit(home_team) if home_team is not None else F.col("home_team_id")
    goal = F.coalesce(F.col("scores_goal") & (F.col("period") != 5), F.lit(False))
    optional = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    return events.select(
        "match_id", "sequence", F.col("event_id").cast("string").alias("event_id"), "period", "elapsed_seconds", "team_id",
        F.when(is_final_third_entry(), channel("end_y")).alias("entry_channel"),
        is_burst_shot().alias("burst_shot"),
        (goal & (F.col("team_id") == home)).alias("goal_home"), (goal & (F.col("team_id") != home)).alias("goal_away"),
        optional("fact_kind").alias("fact_kind"), optional("formation").alias("formation"),
    )


def _fresh() -> dict:
    return {"next": 1, "score": [0, 0], "start": {}, "latest": {}, "entries": {}, "shots": {}, "cool": {}, "shape": {}, "held": {}}


def _split(state: dict, name: str, team: str, period: str, after: int) -> tuple[list[int], list[int]]:
    """Counts per channel: inside the window, and everything else so far. Looks at the seconds of the window only."""
    clocks = state[name][team].get(period, {})
    latest = state["latest"][period]
    if latest - after < len(clocks):
        found = [clocks[s] for s in map(str, range(after + 1, latest + 1)) if s in clocks]
    else:
        found = [counts for second, counts in clocks.items() if int(second) > after]
    recent = [sum(counts[k] for counts in found) for k in range(3)]
    return recent, [a - b for a, b in zip(_totals(state, name, team), recent, strict=True)]


def _totals(state: dict, name: str, team: str) -> list[int]:
    """Counts per channel so far, kept beside those per second; a state from before they were kept is summed once."""
    held = state.setdefault("totals", {}).setdefault(name, {})
    if team not in held:
        held[team] = [sum(v[k] for p in state[name].get(team, {}).values() for v in p.values()) for k in range(3)]
    return held[team]


def _count(state: dict, name: str, team: str, period: str, second: int, place: int) -> None:
    _totals(state, name, team)[place] += 1
    clocks = state[name].setdefault(team, {}).setdefault(period, {})
    clocks.setdefault(str(second), [0, 0, 0])[place] += 1


def _step(state: dict, row: dict, s: ReplaySettings) -> Iterator[dict]:
    """Advance by one event. Counts are kept per second of play, so state follows the clock."""
    period, now, team = str(row["period"]), row["elapsed_seconds"], str(row["team_id"])
    base = {k: row[k] for k in POSITION}
    start = state["start"].setdefault(period, now)
    state["latest"][period] = max(state["latest"].get(period, now), now)
    state["score"][0] += row["goal_home"]
    state["score"][1] += row["goal_away"]
    score = {"home_score": state["score"][0], "away_score": state["score"][1]}
    yield {**base, **score, "kind": "score"}

    if row["entry_channel"]:
        _count(state, "entries", team, period, now, CHANNELS.index(row["entry_channel"]))
    if row["burst_shot"]:
        _count(state, "shots", team, period, now, 0)
    full = now - start >= s.window_seconds

    def ready(kind: str) -> bool:
        until = state["cool"].get(f"{kind}:{team}")
        return full and not (until and until[0] == period and now < until[1])

    def fire(kind: str, **card) -> dict:
        state["cool"][f"{kind}:{team}"] = [period, now + s.cooldown_seconds]
        return {**base, **score, "kind": kind, **card}

    if row["burst_shot"] and ready("burst"):
        earlier = sum(state["latest"][p] - f for p, f in state["start"].items() if int(p) < int(period))
        earlier += now - s.window_seconds - start
        recent, before = _split(state, "shots", team, period, now - s.window_seconds)
        enough = recent[0] >= s.minimum_recent_shots and earlier >= s.minimum_earlier_seconds
        if enough and s.ratio_denominator * recent[0] * earlier >= s.ratio_numerator * before[0] * s.window_seconds:
            yield fire("burst", recent=recent[0], earlier=before[0], earlier_seconds=earlier)
    if row["entry_channel"] and ready("side_shift"):
        recent, before = _split(state, "entries", team, period, now - s.window_seconds)
        r, b = sum(recent), sum(before)
        if r >= s.minimum_recent_entries and b >= s.minimum_baseline_entries:
            gains = [x * b - y * r for x, y in zip(recent, before, strict=True)]
            best = max(range(3), key=lambda k: (gains[k], -k))
            if s.increase_denominator * gains[best] >= s.increase_numerator * r * b:
                yield fire("side_shift", channel=CHANNELS[best], recent=r, earlier=b)
    kind = row["fact_kind"]
    if kind == "substitution":
        yield {**base, "kind": "substitution"}
    elif kind:
        before = state["shape"].get(team)
        state["shape"][team] = [row["formation"], row["event_id"]]
        if kind == "starting":
            yield {**base, "kind": "lineup", "detail": row["formation"]}
        elif before and before[0] != row["formation"]:
            yield {**base, "kind": "formation_change", "detail": f"{before[0]}>{row['formation']}"}


def replay_stream(rows: DataFrame, settings: ReplaySettings | None = None) -> DataFrame:
    """Scores, cards, facts and order errors of an event stream, keyed by match.

    Events wait in state until the sequence before them has been released; one at or below
    the last released is an order error. There is no watermark: order is the sequence.
    """
    chosen = asdict(settings or ReplaySettings())

    def advance(key, frames: Iterator[pd.DataFrame], handle: GroupState) -> Iterator[pd.DataFrame]:
        s = ReplaySettings(**chosen)
        state = json.loads(handle.get[0]) if handle.exists else _fresh()
        out: list[dict] = []
        for frame in frames:
            for row in _records(frame):
                place = str(row["sequence"])
                if row["sequence"] < state["next"] or place in state["held"]:
                    out.append({**{k: row[k] for k in POSITION}, "kind": "order_error"})
                else:
                    state["held"][place] = row
                # Release as soon as the next sequence is here, so little is held.
                while (due := state["held"].pop(str(state["next"]), None)) is not None:
                    out.extend(_step(state, due, s))
                    state["next"] += 1
                if len(out) >= FLUSH_ROWS:
                    yield _frame(out)
                    out = []
        handle.update((json.dumps(state),))
        if out:
            yield _frame(out)

    return rows.select(*INPUT).groupBy("match_id").applyInPandasWithState(
        advance, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout
    )


def stream_time_bins(events: DataFrame, width: int = 300) -> DataFrame:
    """The bin counts as a streaming aggregation (update mode); partial sums before the shuffle."""
    binned = events.withColumn("time_bin", F.floor(F.col("period_seconds") / width).cast("int"))
    return binned.groupBy("match_id", "team_id", "period", "time_bin").agg(
        *[value.alias(name) for name, value in bin_counts().items()]
    )


def unique_cards(cards: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Each card id once. State is kept until the watermark has passed a card by ``delay``; rows behind the watermark are dropped."""
    return cards.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["card_id"])


def card_sink(path: str):
    """A ``foreachBatch`` writer that costs what its batch costs: a batch owns its folder, and a repeated batch writes it over.

    Nothing stored is read again. Card ids of different batches are told apart before the sink (``unique_cards``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(["card_id"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_to_end(query: DataFrame, checkpoint: str, *, mode: str = "append", path: str | None = None, each=None) -> None:
    """Process everything that is there, then stop."""
    writer = query.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", path)
    running = writer.start()
    running.awaitTermination()
