"""The inputs every registered query works on, derived by Spark from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import context as C
from touchline.operators import grid as G
from touchline.operators import presence as P
from touchline.session import cut_lineage
from touchline.sources import bridge

_landed: dict[tuple, DataFrame] = {}


def landed(spark: SparkSession, folder: str, layer: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A layer table, written once per session into the shared folder.

    The layers are what a warehouse keeps: ordered events (a shuffle of everything), the
    event context and the fixed windows. The key holds the input files with length and time of change, so a table that was
    rewritten under the same name is read again.
    """
    key = (*source_key(spark, folder), layer)
    if key not in _landed:
        _landed[key] = cut_lineage(build())
    return _landed[key]


def source_key(spark: SparkSession, folder: str) -> tuple:
    """The session, the folder, and its files of events with length and time of change."""
    return spark.sparkContext.applicationId, folder, _files(spark, bridge.table(spark, folder, "events").inputFiles())


def _files(spark: SparkSession, paths: list[str]) -> tuple:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in sorted(paths):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(name))
        status = path.getFileSystem(hadoop).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)


class Inputs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return bridge.table(self.spark, self.folder, name)

    @cached_property
    def events(self) -> DataFrame:
        return landed(self.spark, self.folder, "events", lambda: bridge.match_events(self.spark, self.folder))

    @cached_property
    def matches(self) -> DataFrame:
        return landed(self.spark, self.folder, "matches", self._matches)

    def _matches(self) -> DataFrame:
        scored = lambda team: F.count_if(F.col("scores_goal") & (F.col("team_id") == team)).cast("int")
        return self.events.groupBy("match_id").agg(
            F.lit(1).alias("home_team_id"),
            F.lit(2).alias("away_team_id"),
            scored(1).alias("home_score"),
            scored(2).alias("away_score"),
        ).select(
            "*",
            (F.col("match_id") % 3).cast("int").alias("competition_id"),
            F.lit(1).alias("season_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.col("match_id").cast("int")).alias("match_date"),
        )

    @cached_property
    def context(self) -> DataFrame:
        return landed(self.spark, self.folder, "context", lambda: C.event_context(self.events, self.matches))

    @cached_property
    def possession_context(self) -> DataFrame:
        return self.context.withColumn("possession_team_id", (1 + F.col("possession") % 2).cast("int"))

    @cached_property
    def players(self) -> DataFrame:
        return landed(self.spark, self.folder, "players", self._players)

    def _players(self) -> DataFrame:
        return self.events.groupBy("match_id", "team_id", "player_id").agg(
            (F.first("player_id") <= 12).alias("started")
        )

    @cached_property
    def appearances(self) -> DataFrame:
        return self.players

    @cached_property
    def spells(self) -> DataFrame:
        p = F.col("player_id")
        none = F.lit(None).cast("int")
        first = F.struct(
            F.lit(1).alias("spell_number"), F.lit(1).alias("start_period"),
            F.when(p > 12, (p * 97) % 900).otherwise(0).alias("start_seconds"),
            F.when(p % 3 == 0, 1).otherwise(none).alias("end_period"),
            F.when(p % 3 == 0, 1200 + p * 10).otherwise(none).alias("end_seconds"),
        )
        second = F.struct(
            F.lit(2).alias("spell_number"), F.lit(1).alias("start_period"),
            (1000 + p * 30).alias("start_seconds"), F.lit(2).alias("end_period"),
            (600 + p * 5).alias("end_seconds"),
        )
        both = F.array_compact(F.array(first, F.when(p % 4 < 2, second)))
        rows = self.players.select("match_id", "team_id", "player_id", F.inline(both))
        seconds = {c: F.col(c).cast("decimal(8,3)") for c in ("start_seconds", "end_seconds")}
        return rows.withColumns(seconds)

    @cached_property
    def substitutions(self) -> DataFrame:
        return self.players.where("player_id % 5 = 0").select(
            "match_id", "team_id", F.col("player_id").alias("player_off_id"),
            # A team mate comes on; in every ninth match somebody of the other team.
            F.expr("player_id + case when match_id % 9 = 4 then 1 else -4 end").cast("int").alias("player_on_id"), F.lit(2).alias("period"),
            F.lit(600).cast("decimal(8,3)").alias("period_seconds"),
        )

    @cached_property
    def intervals(self) -> DataFrame:
        return P.player_intervals(self.spells, self.events, self.substitutions)

    @cached_property
    def spans(self) -> DataFrame:
        return P.player_period_spans(self.intervals, self.events)

    @cached_property
    def bins(self) -> DataFrame:
        return G.team_time_bins(self.context, self.events, self.matches)

    @cached_property
    def windows(self) -> DataFrame:
        build = lambda: G.fixed_windows(self.context, self.events, self.matches)
        return landed(self.spark, self.folder, "windows", build)

    @cached_property
    def pairs(self) -> DataFrame:
        return G.window_pairs(self.windows)

    @cached_property
    def facts(self) -> DataFrame:
        """Recorded lineups, shifts and substitutions taken from some recoveries."""
        e = F.col("event_id")
        kind = F.when(e % 10 == 0, "substitution").when(e % 10 == 3, "starting").when(e % 10 == 6, "tactical_shift")
        rows = self.events.where("event_type = 'ball_recovery'").withColumn("kind", kind)
        shape = F.when(e % 3 == 0, "442").when(e % 3 == 1, "433").otherwise("352")
        sub = F.col("kind") == "substitution"
        return rows.where("kind is not null").select(
            "match_id", "team_id", "sequence", "event_id", "period", "minute", "second", "kind",
            F.when(~sub, shape).alias("formation"),
            F.when(sub, F.col("player_id")).alias("player_off_id"),
            F.when(sub, F.col("player_id") + 100).alias("player_on_id"),
        )

    @cached_property
    def presence_changes(self) -> DataFrame:
        """Starters on from the first event; later substitutions and dismissals change it."""
        start = self.players.where("started").select(
            "match_id", "team_id", "player_id", F.lit(1).alias("sequence"), F.lit(True).alias("on")
        )
        off = F.struct(F.col("player_id"), F.lit(False).alias("on"))
        on = F.struct((F.col("player_id") % 20 + 1 + F.col("team_id") % 2).cast("int").alias("player_id"), F.lit(True).alias("on"))
        swap = self.events.where("event_type = 'ball_recovery' and event_id % 15 = 0 and sequence > 1").select(
            "match_id", "team_id", "sequence", F.inline(F.array(off, on))
        )
        return start.unionByName(swap.select(*start.columns))
