"""Prefix computations over an ordered stream that stay parallel inside one key.

A match may hold a large share of all rows, so no window here spans a whole match of
events. Each stream is cut into blocks of consecutive positions; rows are scanned inside
their block and the block totals (one small row per block) carry the state across blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``sum`` or ``max`` of ``value`` over the prefix.

    ``within`` adds key columns to the stream key (for instance the period);
    ``exclusive`` leaves the current row out; ``backward`` runs from the end of the stream.
    """

    name: str
    kind: str
    value: Column
    within: tuple[str, ...] = ()
    exclusive: bool = False
    backward: bool = False


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    measures: Sequence[Running],
    descending: bool = False,
    keep_block: bool = False,
) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order``; ``block`` must not decrease with it.

    One shuffle of the rows by (keys, block), plus the much smaller block totals. ``keep_block`` leaves the column ``_block``,
    so that a later join on it finds the rows in place.
    """
    extra = sorted({column for m in measures for column in m.within} - set(keys))
    fold = {"sum": F.sum, "max": F.max}
    unbounded = Window.unboundedPreceding

    def direction(m: Running, column: str) -> Column:
        return F.col(column).desc() if m.backward != descending else F.col(column).asc()

    rows = df.select(
        "*", block.cast("long").alias("_block"), *[m.value.alias(f"_v_{m.name}") for m in measures]
    )
    carried = (
        rows.groupBy(*keys, "_block", *extra)
        .agg(*[fold[m.kind](f"_v_{m.name}").alias(f"_t_{m.name}") for m in measures])
        .select(
            *keys,
            "_block",
            *extra,
            *[
                fold[m.kind](f"_t_{m.name}")
                .over(
                    Window.partitionBy(*keys, *m.within)
                    .orderBy(direction(m, "_block"))
                    .rangeBetween(unbounded, -1)
                )
                .alias(f"_c_{m.name}")
                for m in measures
            ],
        )
    )
    inside = [
        fold[m.kind](f"_v_{m.name}")
        .over(
            Window.partitionBy(*keys, "_block", *m.within)
            .orderBy(*[direction(m, c) for c in order])
            .rowsBetween(unbounded, -1 if m.exclusive else 0)
        )
        .alias(f"_i_{m.name}")
        for m in measures
    ]
    results = []
    for m in measures:
        here, before = F.col(f"_i_{m.name}"), F.col(f"_c_{m.name}")
        if m.kind == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            value = F.greatest(here, before)
        results.append(value.alias(m.name))
    # Asked for explicitly: a frame already placed by a match key would satisfy the window
    # as it is, and leave a very large match in one task.
    return (
        rows.repartition(*keys, "_block")
        .select("*", *inside)
        .join(carried, [*keys, "_block", *extra])
        .select(*[F.col(f"`{c}`") for c in df.columns], *(["_block"] if keep_block else []), *results)
    )


def with_value_blocks(rows: DataFrame, keys: Sequence[str], value: str, name: str = "_cut", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the block of each row's ``value`` in its key; blocks never decrease with the value and hold about as many rows each.

    Cuts are quantiles of the key's own rows, taken from mergeable sketches, so they follow any distribution; keys with at most
    ``block_rows`` rows are one block. ``rows`` should hold a distinct value of a key once: equal values share a block. There are
    as many blocks as shuffle partitions, 2 at least and 1000 at most.
    """
    blocks = min(1000, max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    at = F.col(value).cast("double")
    spots = [k / blocks for k in range(1, blocks)]
    cuts = rows.groupBy(*keys).agg(F.count("*").alias("_size"), F.percentile_approx(at, spots, 20 * blocks).alias("_cuts"))
    cuts = cuts.where(F.col("_size") > block_rows).select(*keys, "_cuts")
    below = F.size(F.filter("_cuts", lambda c: c < at))
    return rows.join(cuts, list(keys), "left").withColumn(name, F.when(F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts")


SALTS = 16


def join_small(rows: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows of a stream with a few rows per key, without placing a whole key in one task.

    The stream side is salted by its sequence and the small side repeated per salt, so a
    very large match is spread, and a later aggregation still combines before its shuffle.
    """
    left = rows.withColumn("_salt", F.pmod(F.col("sequence"), F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def join_per_block(rows: DataFrame, small: DataFrame, on: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Join rows of a stream with a few rows per key, repeated once per block of the key.

    Like ``join_small`` without a fixed number of salts: a short stream, of which there may be very many, is not repeated at all.
    """
    place = sequence_block(block_rows).cast("long").alias("_place")
    spots = rows.select(*on, place).distinct()
    return rows.select("*", place).join(small.join(spots, list(on)), [*on, "_place"]).drop("_place")


def sequence_block(size: int = BLOCK_ROWS, column: str = "sequence") -> Column:
    return F.floor((F.col(column) - 1) / F.lit(size))


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str
) -> DataFrame:
    """Row number per ``keys`` without sorting a whole key in one task."""
    return running(df, keys, order, block, [Running(name, "sum", F.lit(1))])


def prefix_window(
    rows: DataFrame,
    measures: dict[str, Column],
    *,
    trigger: Column,
    window_seconds: int,
    keys: Sequence[str] = ("match_id",),
    entity: Sequence[str] = ("team_id",),
    block_rows: int = BLOCK_ROWS,
    also: Sequence[Running] = (),
) -> DataFrame:
    """For each trigger row: sums over the recent window and over everything earlier.

    Both parts hold only rows with a sequence at or below the trigger's. Recent means the
    same period and ``elapsed_seconds > now - window``; there is no upper clock bound, so
    rows whose clock ran ahead count. Earlier is the rest of the prefix, all periods.

    recent = prefix sum in the period
             - sum of period rows with clock <= now - window   (by clock, any sequence)
             + those of them that only come after the trigger   (late rows)

    The second term is a clock histogram with at most one row per second. Late rows need a
    clock that stepped back by a whole window; they are normally none, and are counted by
    a binary decomposition of the clock axis, so no trigger-row pairs are formed.
    """
    entity = tuple(entity)
    owner = [*keys, *entity]
    names = list(measures)
    clock = F.col("elapsed_seconds")
    flagged = rows.select(
        "*", trigger.alias("_trigger"), *[value.alias(name) for name, value in measures.items()]
    )
    fact = F.lit(False)
    for name in names:
        fact = fact | (F.col(name) != 0)
    in_period = (*entity, "period")
    scans = [Running(f"prefix_{n}", "sum", F.col(n), entity) for n in names]
    scans += [Running(f"period_{n}", "sum", F.col(n), in_period) for n in names]
    scans += [
        Running("_ahead", "max", F.when(F.col("_trigger"), clock), in_period),
        Running("_behind", "max", F.when(fact, -clock), in_period, True, True),
    ]
    scanned = running(flagged, keys, ["sequence"], sequence_block(block_rows), [*scans, *also], keep_block=True)
    expired = _expired_by_clock(flagged, fact, names, owner, window_seconds)
    late = _late_rows(scanned, fact, names, owner, window_seconds, block_rows)
    joined = (
        scanned.where("_trigger")
        .join(late, [*owner, "_block", "sequence"], "left")
        .join(expired, [*owner, "period", "elapsed_seconds"], "left")
    )
    out = []
    for n in names:
        gone = F.coalesce(F.col(f"_e_{n}"), F.lit(0)) - F.coalesce(F.col(f"_l_{n}"), F.lit(0))
        recent = F.col(f"period_{n}") - gone
        out += [recent.alias(f"recent_{n}"), (F.col(f"prefix_{n}") - recent).alias(f"earlier_{n}")]
    return joined.select(*[F.col(c) for c in rows.columns], *[m.name for m in also], *out)


def _expired_by_clock(flagged, fact, names, owner, window_seconds) -> DataFrame:
    """Per trigger second: sum of period rows whose clock is at or below now - window."""
    group = [*owner, "period"]
    leaves = F.when(
        fact,
        F.struct(
            (F.col("elapsed_seconds") + window_seconds).alias("at"),
            F.lit(False).alias("asked"),
            *[F.col(n).alias(f"v_{n}") for n in names],
        ),
    )
    asks = F.when(
        F.col("_trigger"),
        F.struct(
            F.col("elapsed_seconds").alias("at"),
            F.lit(True).alias("asked"),
            *[(F.col(n) * 0).alias(f"v_{n}") for n in names],
        ),
    )
    # At most two rows per second of play and period, so this window stays small.
    by_clock = (
        Window.partitionBy(*group)
        .orderBy("at", "asked")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        flagged.where(fact | F.col("_trigger"))
        .select(*group, F.explode(F.array_compact(F.array(leaves, asks))).alias("_p"))
        .groupBy(*group, F.col("_p.at").alias("at"), F.col("_p.asked").alias("asked"))
        .agg(*[F.sum(f"_p.v_{n}").alias(n) for n in names])
        .select(
            *group,
            F.col("at").alias("elapsed_seconds"),
            "asked",
            *[F.sum(n).over(by_clock).alias(f"_e_{n}") for n in names],
        )
        .where("asked")
        .drop("asked")
    )


def _late_rows(scanned, fact, names, owner, window_seconds, block_rows) -> DataFrame:
    """Per trigger: sum of period rows after it whose clock is at or below now - window."""
    group = [*owner, "period"]
    clock = F.col("elapsed_seconds")
    is_late = fact & (F.col("_ahead") >= clock + window_seconds) & (clock >= 0)
    asks = F.col("_trigger") & (-F.col("_behind") <= clock - window_seconds)
    limit = clock - window_seconds + 1
    nodes = F.expr("sequence(0, 30)")
    even = lambda level, value: F.when(
        (value >= 0) & (value % 2 == 0), F.struct(level.alias("level"), value.alias("node"))
    )
    shift = lambda value, level: F.call_function("shiftright", value.cast("int"), level)
    point_nodes = F.transform(nodes, lambda level: even(level, shift(clock, level)))
    asked_nodes = F.transform(nodes, lambda level: even(level, shift(limit, level) - 1))
    branch = lambda when, asked, found: F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(F.lit(asked).alias("asked"), F.array_compact(found).alias("nodes")),
    )
    parts = F.array_compact(
        F.array(branch(is_late, False, point_nodes), branch(asks, True, asked_nodes))
    )
    rows = (
        scanned.where(F.coalesce(is_late, F.lit(False)) | F.coalesce(asks, F.lit(False)))
        .select(*group, F.col("_block").alias("_at"), "sequence", *names, F.explode(parts).alias("_p"))
        .select(*group, "_at", "sequence", *names, "_p.asked", F.explode("_p.nodes").alias("_n"))
        .select(
            *group,
            "_at",
            "sequence",
            "asked",
            "_n.level",
            "_n.node",
            *[F.when(F.col("asked"), F.col(n) * 0).otherwise(F.col(n)).alias(n) for n in names],
        )
    )
    # Backward in sequence; at one sequence the question comes before the point.
    counted = running(
        rows,
        [*group, "level", "node"],
        ["sequence", "asked"],
        sequence_block(block_rows),
        [Running(f"_l_{n}", "sum", F.col(n)) for n in names],
        descending=True,
    )
    return (
        counted.where("asked")
        .groupBy(*owner, F.col("_at").alias("_block"), "sequence")
        .agg(*[F.sum(f"_l_{n}").alias(f"_l_{n}") for n in names])
    )


def greedy_cooldown(
    candidates: DataFrame,
    seconds: int,
    keys: Sequence[str] = ("match_id", "team_id", "period"),
) -> DataFrame:
    """Keep the first candidate by sequence, then drop those before ``fired + seconds``.

    The limit only rises, so once one candidate of a given second was kept or dropped every
    later one with the same or a lower clock is dropped too. The first candidate of each
    second is therefore enough, which bounds the ordered scan by the seconds of a period.
    Without a cooldown every candidate not earlier than all before it is kept. A negative one is an error.
    """
    keys = list(keys)
    if seconds < 0:
        raise ValueError("a cooldown cannot be negative")
    if seconds == 0:
        latest = running(candidates, keys, ["sequence"], sequence_block(), [Running("_latest", "max", F.col("elapsed_seconds"))])
        return latest.where("elapsed_seconds >= _latest").select(*candidates.columns)
    rest = [c for c in candidates.columns if c not in keys]
    row = F.struct("sequence", "elapsed_seconds", *[c for c in rest if c not in ("sequence", "elapsed_seconds")])
    firsts = candidates.groupBy(*keys, "elapsed_seconds").agg(F.min_by(row, "sequence").alias("_row"))
    ordered = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    kept = F.filter(
        F.aggregate(
            "_rows",
            F.array(F.get("_rows", F.lit(0))),
            lambda kept, r: F.when(
                r["elapsed_seconds"] >= F.element_at(kept, -1)["elapsed_seconds"] + seconds,
                F.concat(kept, F.array(r)),
            ).otherwise(kept),
        ),
        lambda r: r.isNotNull(),
    )
    return (
        ordered.select(*keys, F.explode(kept).alias("_row"))
        .select(*keys, "_row.*")
        .select(*candidates.columns)
    )
