"""A player's part in the team's passes, one block of consecutive events at a time.

A group holds the events of one block and a few rows on what came before it: who was on, totals of each player, and counts by
second of the passes that may still be recent. Squads and seconds bound those, so a match of any length is spread over blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from touchline.functions.prefix import sequence_block
from touchline.session import cut_lineage

ACT, TURN, STATE, TEAM, START, TOTAL, RECENT = range(7)
COUNTS = ["mine", "mine_on", "team_on", "team"]
# Triggers compared with the passes of a block at a time.
SLICE = 1024

# Workers get the functions below with the job, so they need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _numbers(column) -> np.ndarray:
    """Values as doubles; nulls are NaN, which no comparison holds for."""
    return column.cast(pa.float64()).to_numpy()


def _whole(column) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy()


def _teams(table: pa.Table) -> Iterator[tuple]:
    """Per team of a block: its rows of each kind, its players, who is on at each event, its passes and what each adds to the counts."""
    kinds = table["_kind"].to_numpy()
    acts = table.filter(pa.array(kinds == ACT)).sort_by("sequence")
    if not acts.num_rows:
        return
    rest = table.filter(pa.array(kinds != ACT))
    owner, kind = _whole(rest["team_id"].fill_null(0)), rest["_kind"].to_numpy()
    at, passed = _whole(acts["sequence"]), acts["_pass"].to_numpy(zero_copy_only=False)
    actor, passer = _numbers(acts["team_id"]), _numbers(acts["player_id"])
    for team in np.unique(owner[kind == TEAM]):
        own = {k: rest.filter(pa.array((kind == k) & (owner == team))) for k in (TURN, STATE, TOTAL, RECENT)}
        spots = np.flatnonzero(passed & (actor == team))
        seen = passer[spots]
        players = np.unique(np.concatenate([seen[~np.isnan(seen)].astype(np.int64), *[_whole(own[k]["player_id"]) for k in (TURN, STATE)]]))
        on = np.tile(np.isin(players, _whole(own[STATE]["player_id"])), (len(at), 1))
        turns = own[TURN].sort_by([("sequence", "ascending"), ("on", "ascending")])
        who, when, turned = _whole(turns["player_id"]), _whole(turns["sequence"]), turns["on"].to_numpy(zero_copy_only=False)
        for player in np.unique(who):
            mine = who == player
            last = np.searchsorted(when[mine], at, "right") - 1
            column = np.searchsorted(players, player)
            on[:, column] = np.where(last >= 0, turned[mine][last], on[:, column])
        hit = seen[:, None] == players[None, :]
        adds = np.concatenate([hit, hit & on[spots], on[spots], np.ones((len(spots), 1), bool)], axis=1).astype(np.float64)
        yield team, acts, at, own, players, on, spots, adds


def _columns(rows: pa.Table, players: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of carried rows as (row, column of ``adds``, value); rows without a player are the team's."""
    player, size = _numbers(rows["player_id"]), len(players)
    of_team = np.isnan(player)
    found = ~of_team & np.isin(player, players)
    spot = np.searchsorted(players, player[found])
    out = [(np.flatnonzero(found), spot + k * size, _numbers(rows[name])[found]) for k, name in enumerate(COUNTS[:3])]
    return [*out, (np.flatnonzero(of_team), np.full(of_team.sum(), 3 * size), _numbers(rows["team"])[of_team])]


def _best(increase: np.ndarray) -> int:
    """The largest increase to twelve places, then the smallest player."""
    near = np.flatnonzero(increase >= increase.max() - 2e-12)
    if len(near) == 1:
        return int(near[0])
    places = [Decimal(repr(float(increase[i]))).quantize(Decimal("1e-12"), ROUND_HALF_UP) for i in near]
    return int(near[places.index(max(places))])


def block_facts(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Counts of a block by team, player, period and second."""
    parts = []
    for team, acts, _, _, players, _, spots, adds in _teams(table):
        taken = acts.take(pa.array(spots))
        size = len(players)
        for k, player in enumerate([*players.tolist(), None]):
            counts = {n: adds[:, k + j * size] if player is not None else np.zeros(len(spots)) for j, n in enumerate(COUNTS[:3])}
            counts["team"] = adds[:, -1] if player is None else np.zeros(len(spots))
            some = np.flatnonzero(sum(counts.values()) > 0)
            rows = taken.take(pa.array(some))
            values = {"match_id": rows["match_id"], "_block": rows["_block"], "period": rows["period"], "elapsed_seconds": rows["elapsed_seconds"]}
            values |= {"team_id": pa.array([int(team)] * len(some)), "player_id": pa.array([player] * len(some), pa.int64())}
            values |= {n: pa.array(v[some].astype(np.int64)) for n, v in counts.items()}
            parts.append(pa.table({f.name: values[f.name].cast(f.type) for f in schema}, schema=schema))
    return pa.concat_tables(parts).combine_chunks() if parts else schema.empty_table()


def block_checks(table: pa.Table, schema: pa.Schema, window_seconds: int, least: tuple[int, int], share: tuple[int, int], gain: tuple[int, int]) -> pa.Table:
    """The outcome of each check of a block, with the player of the best increase."""
    (minimum_recent, minimum_baseline), (sn, sd), (dn, dd) = least, share, gain
    starts = table.filter(pa.array(table["_kind"].to_numpy() == START))
    start = dict(zip(starts["period"].to_pylist(), starts["elapsed_seconds"].to_pylist(), strict=True))
    parts = []
    for team, acts, at, own, players, on, spots, adds in _teams(table):
        size = len(players)
        clock, period = _numbers(acts["elapsed_seconds"]), _whole(acts["period"])
        full = np.array([np.nan if start.get(p) is None else start[p] for p in period.tolist()], np.float64) + window_seconds
        triggers = np.flatnonzero((period != 5) & (clock >= full))
        totals = np.zeros(3 * size + 1)
        for _, column, value in _columns(own[TOTAL], players):
            np.add.at(totals, column, value)
        # Passes of earlier blocks by period and second, then those of this block.
        moments = np.stack([_numbers(own[RECENT]["period"]), _numbers(own[RECENT]["elapsed_seconds"])], axis=1)
        carried, row_of = np.unique(moments, axis=0, return_inverse=True)
        before = np.zeros((len(carried), 3 * size + 1))
        for row, column, value in _columns(own[RECENT], players):
            np.add.at(before, (row_of.reshape(-1)[row], column), value)
        facts = np.concatenate([before, adds])
        fact_period, fact_clock = np.concatenate([carried[:, 0], period[spots]]), np.concatenate([carried[:, 1], clock[spots]])
        fact_at = np.concatenate([np.full(len(carried), np.iinfo(np.int64).min), at[spots]])
        upto = np.concatenate([np.zeros((1, 3 * size + 1)), np.cumsum(adds, axis=0)])
        for first in range(0, len(triggers), SLICE):
            t = triggers[first : first + SLICE]
            inside = (fact_period == period[t, None]) & (fact_clock > clock[t, None] - window_seconds) & (fact_at <= at[t, None])
            recent = inside.astype(np.float64) @ facts
            earlier = totals + upto[np.searchsorted(at[spots], at[t], "right")] - recent
            recent, earlier = np.rint(recent).astype(np.int64), np.rint(earlier).astype(np.int64)
            mine, base = recent[:, :size], recent[:, -1:]
            was, was_base = earlier[:, size : 2 * size], earlier[:, 2 * size : 3 * size]
            evaluable = on[t] & (was_base >= minimum_baseline) & (base >= minimum_recent)
            fires = evaluable & (sd * mine >= sn * base) & (dd * (mine * was_base - was * base) >= dn * base * was_base)
            card = fires.any(axis=1)
            outcome = np.where(~evaluable.any(axis=1), "insufficient_data", np.where(card, "card", "no_change"))
            with np.errstate(divide="ignore", invalid="ignore"):
                increase = np.where(fires, mine / base - was / was_base, -np.inf)
            pick = np.array([_best(row) if c else 0 for row, c in zip(increase, card, strict=True)], np.int64)
            lines = np.arange(len(t))
            chosen = lambda values: pa.array(values[lines, pick] if size else np.zeros(len(t), np.int64), mask=~card)
            rows = acts.take(pa.array(t))
            values = {c: rows[c] for c in ("match_id", "period", "sequence", "elapsed_seconds", "event_id", "minute")}
            values |= {"team_id": pa.array([int(team)] * len(t)), "outcome": pa.array(outcome.astype(object), pa.string()), "recent_base": pa.array(base[:, 0])}
            values |= {"recent_value": chosen(mine), "earlier_value": chosen(was), "earlier_base": chosen(was_base)}
            values["player_id"] = chosen(np.tile(players, (len(t), 1)))
            parts.append(pa.table({f.name: values[f.name].cast(f.type) for f in schema}, schema=schema))
    return pa.concat_tables(parts).combine_chunks() if parts else schema.empty_table()


def _until(rows: DataFrame, last: DataFrame, owner: list[str]) -> DataFrame:
    """Each row once per later block for which it is the owner's latest."""
    following = F.lead("_block").over(Window.partitionBy(*owner).orderBy("_block"))
    rows = rows.withColumn("_next", following).join(last, "match_id")
    stop = F.least(F.coalesce("_next", "_last"), "_last")
    return rows.where(F.col("_block") < stop).withColumn("_block", F.explode(F.sequence(F.col("_block") + 1, stop))).drop("_next", "_last")


def block_rows(acts: DataFrame, turns: DataFrame, last: DataFrame, spots: DataFrame) -> DataFrame:
    """Rows of every block that its events need to know who is on."""
    owner = ["match_id", "team_id", "player_id"]
    ends = turns.groupBy(*owner, "_block").agg(F.max(F.struct("sequence", "on"))["on"].alias("on"))
    states = _until(ends, last, owner).where("on")
    blocks = spots.groupBy("match_id", "_block").agg(F.lit(1).alias("_one")).drop("_one")
    teams = acts.where("team_id is not null").groupBy("match_id", "team_id").agg(F.lit(1).alias("_one")).drop("_one")
    kinds = [(acts, ACT), (turns, TURN), (states, STATE), (blocks.join(teams, "match_id"), TEAM)]
    return _union([rows.withColumn("_kind", F.lit(kind)) for rows, kind in kinds])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def involvement(
    events: DataFrame, changes: DataFrame, passes, *, window_seconds: int, least: tuple[int, int], share: tuple[int, int], gain: tuple[int, int], size: int
) -> DataFrame:
    """Every check of both teams of each match; ``passes`` tells the passes that count, ``size`` the events of a block."""
    key = ["match_id", "_block"]
    block = sequence_block(size).cast("long").alias("_block")
    acts = events.where("match_id is not null and sequence is not null and period is not null").select(
        "match_id", block, "team_id", "player_id", "period", "sequence", "elapsed_seconds", "event_id", "minute", F.coalesce(passes, F.lit(False)).alias("_pass")
    )
    named = changes.where("match_id is not null and team_id is not null and player_id is not null and sequence is not null")
    turns = named.select("match_id", block, "team_id", "player_id", "sequence", F.coalesce("on", F.lit(False)).alias("on"))
    spots = acts.groupBy(*key, "period").agg(
        F.min("elapsed_seconds").alias("_from"), F.max("elapsed_seconds").alias("_to"), F.min(F.struct("sequence", "elapsed_seconds")).alias("_first")
    )
    last = spots.groupBy("match_id").agg(F.max("_block").alias("_last"))
    rows = block_rows(acts, turns, last, spots)
    starts = spots.groupBy("match_id", "period").agg(F.min("_first")["elapsed_seconds"].alias("elapsed_seconds"), F.max("_to").alias("_most"))
    held = spots.join(starts, ["match_id", "period"])

    # What a block hands on: only blocks that another one follows.
    followed = spots.join(last, "match_id").where("_block < _last").groupBy(*key).agg(F.lit(1).alias("_one")).drop("_one")
    types = {f.name: f.dataType for f in [*turns.schema, *acts.schema]}
    shaped = lambda names, counts: T.StructType([T.StructField(c, types[c]) for c in names] + [T.StructField(c, T.LongType()) for c in counts])
    columns = ["match_id", "_block", "team_id", "player_id", "period", "elapsed_seconds"]
    shape = shaped(columns, COUNTS)
    needed = rows.where(f"_kind <> {ACT} or _pass").join(followed, key, "left_semi")
    target = to_arrow_schema(shape)
    facts = cut_lineage(
        needed.groupBy(*key).applyInArrow(lambda table: block_facts(table, target), shape)
        .groupBy(*columns).agg(*[F.sum(n).alias(n) for n in COUNTS])
    )
    owner = ["match_id", "team_id", "player_id"]
    sofar = Window.partitionBy(*owner).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    sums = facts.groupBy(*owner, "_block").agg(*[F.sum(n).alias(n) for n in COUNTS])
    totals = _until(sums.select(*owner, "_block", *[F.sum(n).over(sofar).alias(n) for n in COUNTS]), last, owner)
    # Blocks meet earlier seconds by stretches of a window's length, so only those that may still be recent.
    stretch = lambda c: F.floor(c / window_seconds)
    asks = held.select(
        "match_id", "period", F.col("_block").alias("_asked"), "_from",
        F.explode(F.sequence(stretch(F.col("_from") - window_seconds), stretch(F.greatest("_most", "_from")))).alias("_stretch"),
    )
    recent = (
        facts.withColumn("_stretch", stretch(F.col("elapsed_seconds"))).join(asks, ["match_id", "period", "_stretch"])
        .where((F.col("_block") < F.col("_asked")) & (F.col("elapsed_seconds") > F.col("_from") - window_seconds))
        .groupBy("match_id", F.col("_asked").alias("_block"), "team_id", "player_id", "period", "elapsed_seconds")
        .agg(*[F.sum(n).alias(n) for n in COUNTS])
    )
    whole = _union([
        rows, held.select(*key, "period", "elapsed_seconds").withColumn("_kind", F.lit(START)),
        totals.withColumn("_kind", F.lit(TOTAL)), recent.withColumn("_kind", F.lit(RECENT)),
    ])
    position = ["match_id", "team_id", "period", "sequence", "elapsed_seconds", "event_id", "minute"]
    types["outcome"] = T.StringType()
    out = shaped([*position, "outcome"], ["recent_value", "recent_base", "earlier_value", "earlier_base"]).add("player_id", types["player_id"])
    made = to_arrow_schema(out)
    return whole.groupBy(*key).applyInArrow(lambda table: block_checks(table, made, window_seconds, least, share, gain), out)
