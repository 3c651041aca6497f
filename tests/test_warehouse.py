"""Layers of accepted matches: what is rebuilt, what stays, and what a broken write leaves."""

import pytest
from pyspark.sql import functions as F

from touchline.operators.warehouse import Layer, Warehouse, match_digests


@pytest.fixture
def events(spark):
    rows = [(m, s, 10 * m + s) for m in range(12) for s in range(5 if m else 400)]
    return spark.createDataFrame(rows, "match_id bigint, sequence int, value int")


def layers(events, seen=None):
    def doubled(only):
        kept = only(events)
        if seen is not None:
            seen.append(sorted(r[0] for r in kept.select("match_id").distinct().collect()))
        return kept.select("match_id", "sequence", (2 * F.col("value")).alias("twice"))

    return {"doubled": Layer(doubled, ("match_id", "sequence"))}


def statuses(spark, excluded=()):
    return spark.createDataFrame([(m, "excluded" if m in excluded else "passed") for m in range(12)], "match_id bigint, dq_status string")


def matches_of(df):
    return sorted(r[0] for r in df.select("match_id").distinct().collect())


def test_only_changed_matches_are_built(spark, events, tmp_path):
    house, seen = Warehouse(spark, str(tmp_path), parts=4), []
    done = house.refresh(statuses(spark, {3}), match_digests(events), layers(events, seen), "one")
    assert done == {"doubled": 11} and matches_of(house.read("doubled")) == [m for m in range(12) if m != 3]
    changed = events.withColumn("value", F.when(F.col("match_id") == 5, 0).otherwise(F.col("value")))
    # Match 5 has other content, match 3 passes now, match 0 is excluded, the rest stays.
    done = house.refresh(statuses(spark, {0}), match_digests(changed), layers(changed, seen), "two")
    assert done == {"doubled": 3} and seen[1] == [3, 5]
    found = house.read("doubled")
    assert matches_of(found) == list(range(1, 12))
    assert matches_of(found.where("ingest_run_id = 'two'")) == [3, 5]
    assert found.where("match_id = 5").agg(F.sum("twice")).first()[0] == 0
    # The version before is still there, and nothing is published when nothing changes.
    assert matches_of(house.read("doubled", version=1)) == [m for m in range(12) if m != 3]
    assert house.refresh(statuses(spark, {0}), match_digests(changed), layers(changed), "three") == {"doubled": 0}
    assert house.versions() == [1, 2]
    # A new definition builds everything again.
    again = {"doubled": Layer(layers(changed)["doubled"].build, ("match_id",), version=2)}
    assert house.refresh(statuses(spark, {0}), match_digests(changed), again, "four") == {"doubled": 11}
    contents = house.contents().collect()
    assert [(r["table_name"], r["definition_version"], r["rows"]) for r in contents] == [("doubled", 2, 55)]


def test_a_broken_write_leaves_the_old_layer(spark, events, tmp_path):
    house = Warehouse(spark, str(tmp_path), parts=4)
    house.refresh(statuses(spark), match_digests(events), layers(events), "one")

    def broken(only):
        return only(events).select("match_id", "sequence", F.raise_error(F.lit("broken")).cast("int").alias("twice"))

    with pytest.raises(Exception, match="broken"):
        house.refresh(statuses(spark, {1}), match_digests(events), {"doubled": Layer(broken, version=2)}, "two")
    assert house.versions() == [1] and house.read("doubled").count() == events.count()


def test_the_second_of_two_writers_fails(spark, events, tmp_path):
    one, two = Warehouse(spark, str(tmp_path)), Warehouse(spark, str(tmp_path))
    stale = two.manifest()
    one.refresh(statuses(spark), match_digests(events), layers(events), "one")
    with pytest.raises(RuntimeError, match="another writer"):
        two._publish({"version": stale["version"] + 1, "layers": {}})
    assert two.manifest()["run_id"] == "one"


def test_reading_some_matches_prunes_parts(spark, events, tmp_path):
    house = Warehouse(spark, str(tmp_path), parts=4)
    house.refresh(statuses(spark), match_digests(events), layers(events), "one")
    asked = events.where("match_id = 7").select("match_id")
    found = house.read("doubled", asked)
    assert matches_of(found) == [7]
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_all_matches_excluded_and_empty_input(spark, events, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    none = events.where("false")
    assert house.refresh(statuses(spark), match_digests(none), layers(none), "one") == {"doubled": 0}
    assert house.read("doubled").count() == 0 and house.read("doubled").columns[:3] == ["match_id", "sequence", "twice"]
    house.refresh(statuses(spark), match_digests(events), layers(events), "two")
    house.refresh(statuses(spark, set(range(12))), match_digests(events), layers(events), "three")
    assert house.read("doubled").count() == 0
