"""Ranks and quantiles on any distribution, earlier-match distributions, and claims of hot subjects."""

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from touchline.functions.prefix import with_value_blocks
from touchline.operators import grid, stats, value
from touchline.operators.lineage import covering, freeze_at_kickoff


def close_together(spark, n=20_000):
    """Values that all lie in a millionth, with one far away."""
    return spark.range(n).select((F.lit(0.5) + F.col("id") * F.lit(1e-11)).alias("v"), (F.col("id") % 3 == 0).alias("t"), F.lit(1).alias("k")).union(
        spark.createDataFrame([(1e12, True, 1)], "v double, t boolean, k int")
    )


def test_blocks_follow_the_values(spark):
    cut = with_value_blocks(close_together(spark), ["k"], "v", block_rows=100)
    sizes = [r["count"] for r in cut.groupBy("_cut").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.2 * min(sizes)
    edges = cut.groupBy("_cut").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("_cut").collect()
    assert all(x["b"] < y["a"] for x, y in zip(edges, edges[1:], strict=False))
    small = with_value_blocks(close_together(spark, 50), ["k"], "v")
    assert small.select("_cut").distinct().count() == 1


def test_ranks_of_values_that_lie_close(spark):
    rows = close_together(spark)
    ranked = stats.average_ranks(rows, "v")
    assert ranked.agg(F.sum("v_rank")).first()[0] == 20_001 * 20_002 / 2
    assert ranked.where("v > 1").first()["v_rank"] == 20_001
    found = stats.quantiles(rows, "v", {"low": 0.25, "high": 0.999999}).first()
    assert found["low"] == 0.5 + 5000 * 1e-11 and found["high"] == 1e12
    area = value.auc(rows, "v", "t").first()
    assert area["positives"] + area["negatives"] == 20_001 and 0.49 < area["auc"] < 0.51


def test_order_statistics_of_earlier_days(spark):
    rng = random.Random(1)
    points = Counter((k, rng.randrange(300), rng.choice([0, 1, 2, 5, 63, 64, 1000])) for k in "aab" for _ in range(200))
    asks, want = [], {}
    for k in "ab":
        for day in range(0, 330, 7):
            earlier = sorted(v for (kk, d, v), n in points.items() for _ in range(n) if kk == k and d < day)
            for spot in ("p", "q"):
                if earlier:
                    at = rng.randrange(len(earlier))
                    asks.append((k, day, spot, at))
                    want[k, day, spot] = earlier[at]
    held = spark.createDataFrame([(k, d, v, n) for (k, d, v), n in points.items()], "key string, day int, value bigint, n bigint")
    found = grid.earlier_order_statistics(held, spark.createDataFrame(asks, "key string, day int, spot string, k bigint"), ["key"])
    assert {(r["key"], r["day"], r["spot"]): r["found"] for r in found.collect()} == want
    assert grid.earlier_order_statistics(held.where("false"), spark.createDataFrame([], "key string, day int, spot string, k bigint"), ["key"]).count() == 0


def test_covering_stretches_meet_once(spark):
    rng = random.Random(2)
    spans = [(a, a + rng.randrange(0, 900)) for a in (rng.randrange(700_000, 740_000) for _ in range(60))] + [(0, 1 << 22), (5, 5), (9, 3), (0, 1)]
    rows = spark.createDataFrame(spans, "a bigint, b bigint").select("a", "b", covering(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        days = sorted((s["stretch"] << s["level"], (s["stretch"] + 1) << s["level"]) for s in r["c"])
        assert (not days and r["a"] >= r["b"]) or (days[0][0] == r["a"] and days[-1][1] == r["b"] and all(x[1] == y[0] for x, y in zip(days, days[1:], strict=False)))
        assert len(days) <= 14 * 8


def test_freezing_claims_of_one_hot_subject(spark):
    rng = random.Random(3)
    day0, time0 = datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 1)
    claims = []
    for i in range(400):
        begin = day0 + datetime.timedelta(days=rng.randrange(400)) if i % 9 else None
        until = (begin or day0) + datetime.timedelta(days=rng.randrange(1, 60)) if i % 7 else None
        known = time0 + datetime.timedelta(hours=rng.randrange(9600))
        claims.append((f"c{i}", "hot" if i % 3 else f"s{i}", begin, until, known, known, known + datetime.timedelta(hours=i % 2)))
    asks = [(m, "hot" if m % 4 else f"s{m}", time0 + datetime.timedelta(hours=24 * m + 20), day0 + datetime.timedelta(days=m)) for m in range(300)]
    want = sorted(
        (m, c[0]) for m, s, kickoff, day in asks for c in claims
        if c[1] == s and c[4] < kickoff and c[5] <= kickoff and c[6] <= kickoff and (c[2] is None or c[2] <= day) and (c[3] is None or c[3] > day)
    )
    held = spark.createDataFrame(claims, "claim_id string, subject string, valid_from date, valid_until date, published_at timestamp, retrieved_at timestamp, recorded_at timestamp")
    asked = spark.createDataFrame(asks, "match_id int, subject string, kickoff_utc timestamp, local_date date")
    assert sorted((r["match_id"], r["claim_id"]) for r in freeze_at_kickoff(held, asked).collect()) == want
