"""Reads the given tables as match data, so every operator has ordered events to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.prefix import numbered


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def match_events(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table as one ordered event stream per match (15 users per match)."""
    raw = table(spark, folder, "events").select(
        "event_id",
        "ts",
        (F.expr("user_id div 15")).alias("match_id"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        # Wall-clock seconds of a zone-less timestamp, whatever the session time zone.
        (
            F.unix_date(F.col("ts").cast("date")).cast("bigint") * 86400
            + F.hour("ts") * 3600
            + F.minute("ts") * 60
            + F.second("ts")
        ).alias("es"),
    )
    # One minute of one match is a block, so a match of any size is numbered in parallel.
    ordered = numbered(
        raw, ["match_id"], ["ts", "event_id"], F.floor(F.col("es") / 60), "sequence"
    )
    shot = F.col("kind") == "purchase"
    seconds = F.floor(((F.col("es") - 1704067200) % 1296000) / 480).cast("int")
    odd = F.col("event_id") % 2
    return ordered.withColumn("kind", F.col("event_type")).select(
        "match_id",
        "event_id",
        F.col("sequence").cast("int").alias("sequence"),
        F.when(F.col("es") - 1704067200 < 1296000, 1).otherwise(2).alias("period"),
        F.floor(seconds / 60).cast("int").alias("minute"),
        (seconds % 60).cast("int").alias("second"),
        seconds.alias("elapsed_seconds"),
        seconds.cast("decimal(8,3)").alias("period_seconds"),
        (1 + odd).cast("int").alias("team_id"),
        (F.expr("k div 10") * 2 + 1 + odd).cast("int").alias("player_id"),
        F.when(F.col("kind") == "click", "pass")
        .when(F.col("kind") == "view", "carry")
        .when(shot, "shot")
        .when(F.col("kind") == "signup", "pressure")
        .otherwise("ball_recovery")
        .alias("event_type"),
        (F.col("k") * F.lit(1.2)).alias("x"),
        F.when(F.col("value") < 80, F.col("value")).otherwise(F.lit(80.0)).alias("y"),
        (((F.col("k") * 37 + F.col("event_id")) % 100) * F.lit(1.2)).alias("end_x"),
        (((F.col("event_id") * 13) % 801).cast("double") / F.lit(10.0)).alias("end_y"),
        (F.col("event_id") % 5 != 0).alias("completed"),
        (F.col("event_id") % 7 != 0).alias("open_play"),
        (shot & (F.col("event_id") % 11 == 0)).alias("penalty"),
        (shot & (F.col("event_id") % 9 == 0)).alias("scores_goal"),
        F.when(shot, ((F.col("event_id") % 97) / F.lit(100.0)).cast("decimal(18,12)")).alias(
            "provider_xg"
        ),
        (F.expr("(cast(sequence as int) - 1) div 8") + 1).cast("int").alias("possession"),
    )


# The same bridge for the comparison engine; ``me`` is the event stream.
BRIDGE_SQL = """
bk as (select event_id, ts, user_id // 15 as match_id, event_type as kind, value,
         cast(props->>'$.k' as int) as k, cast(floor(epoch(ts)) as bigint) as es from events),
bo as (select *, row_number() over (partition by match_id order by ts, event_id) as seq,
         cast(floor(((es - 1704067200) % 1296000) / 480) as int) as sec from bk),
me as (select match_id, event_id, cast(seq as int) as sequence,
  case when es - 1704067200 < 1296000 then 1 else 2 end as period,
  sec // 60 as minute, sec % 60 as second, sec as elapsed_seconds,
  cast(sec as decimal(8,3)) as period_seconds,
  cast(1 + event_id % 2 as int) as team_id,
  cast((k // 10) * 2 + 1 + event_id % 2 as int) as player_id,
  case kind when 'click' then 'pass' when 'view' then 'carry' when 'purchase' then 'shot'
       when 'signup' then 'pressure' else 'ball_recovery' end as event_type,
  k * 1.2e0 as x, case when value < 80 then value else 80e0 end as y,
  ((k * 37 + event_id) % 100) * 1.2e0 as end_x,
  cast((event_id * 13) % 801 as double) / 10e0 as end_y,
  event_id % 5 <> 0 as completed, event_id % 7 <> 0 as open_play,
  kind = 'purchase' and event_id % 11 = 0 as penalty,
  kind = 'purchase' and event_id % 9 = 0 as scores_goal,
  case when kind = 'purchase' then cast((event_id % 97) / 100e0 as decimal(18,12)) end as provider_xg,
  cast((seq - 1) // 8 + 1 as int) as possession
from bo)"""
