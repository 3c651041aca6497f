"""Frozen splits and the card sink: what is stored stays, what is repeated adds nothing."""

import pytest
from pyspark.sql import functions as F

from touchline.operators.splits import SplitArchive
from touchline.streaming import replay


def split_of(spark, test=()):
    return spark.range(40).select(F.col("id").alias("match_id"), F.when(F.col("id").isin(list(test)), "test").otherwise("development").alias("bucket"))


def test_frozen_splits_are_numbered_and_read_back(spark, tmp_path):
    archive = SplitArchive(spark, str(tmp_path / "splits"))
    assert archive.versions() == {}
    assert archive.freeze(split_of(spark, {3})) == 1 and archive.freeze(split_of(spark, {3}).repartition(3)) == 1
    assert archive.freeze(split_of(spark, {3, 4})) == 2 and archive.freeze(split_of(spark, {3})) == 3
    assert archive.verify(split_of(spark, {3}), 1).isEmpty()
    assert sorted((r["match_id"], r["bucket"], r["only_in"]) for r in archive.verify(split_of(spark, {3}), 2).collect()) == [(4, "development", "computed"), (4, "test", "frozen")]


def test_an_edited_split_is_refused(spark, tmp_path):
    archive = SplitArchive(spark, str(tmp_path / "splits"))
    archive.freeze(split_of(spark, {3}))
    name = archive.versions()[1]
    split_of(spark, {5}).write.mode("overwrite").parquet(str(tmp_path / "splits" / f"version-000001-{name}"))
    with pytest.raises(ValueError, match="edited"):
        archive.read(1)


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    write = replay.card_sink(str(tmp_path / "cards"))
    batch = lambda *ids: spark.createDataFrame([(c, 1) for c in ids], "card_id string, match_id int")
    for number, ids in ((0, ("a", "b", "b")), (1, ("c",)), (1, ("c",)), (2, ()), (0, ("a", "b"))):
        write(batch(*ids), number)
    assert sorted(r["card_id"] for r in spark.read.parquet(str(tmp_path / "cards")).collect()) == ["a", "b", "c"]


def test_state_of_cards_ends_with_the_watermark(spark, tmp_path):
    """The second copy comes within the delay in one case, far behind the watermark in the other; neither is stored again."""
    rows = [("a", 0), ("b", 10), ("a", 0), ("c", 5000), ("d", 9000), ("a", 0)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("card_id string, t timestamp").parquet(str(tmp_path / "in"))
    for card, at in rows:  # one file and one run after the other, so that the order is known
        spark.createDataFrame([(card, at)], "card_id string, at int").select("card_id", F.timestamp_seconds(F.col("at") + 100_000).alias("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        unique = replay.unique_cards(stream, "t", "60 seconds").writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        query = unique.foreachBatch(replay.card_sink(str(tmp_path / "out"))).start()
        query.awaitTermination()
    assert sorted(r["card_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "d"]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept and kept[-1] <= 2
