"""Cases that the given tables never hold: extreme values, repeated receipts, late periods, no cooldown, rewritten tables."""

import hashlib
import json

import pytest

from touchline.functions.prefix import greedy_cooldown
from touchline.operators import detect, lineage, stats
from touchline.plans import inputs
from touchline.session import shared_folder
from touchline.sources import raw


@pytest.mark.parametrize("step", [1e-8, 1.0, 1e10, 1e100])
def test_pearson_at_any_scale(spark, step):
    rows = spark.createDataFrame([(i * step, (2 * i + 1) * step) for i in range(5)], "x double, y double")
    found = stats.pearson(rows, "x", "y").first()
    assert found["observations"] == 5 and found["pearson"] == pytest.approx(1.0)


def test_pearson_without_spread_or_rows(spark):
    rows = spark.createDataFrame([(1.0, float(i)) for i in range(4)], "x double, y double")
    assert stats.pearson(rows, "x", "y").first()["pearson"] is None
    assert stats.pearson(rows.limit(2), "y", "x").first()["pearson"] is None


def test_no_cooldown_keeps_every_candidate_in_order(spark):
    rows = spark.createDataFrame([(1, 1, 1, s, t) for s, t in ((1, 10), (2, 10), (3, 12), (4, 11), (5, 12))], "match_id int, team_id int, period int, sequence int, elapsed_seconds int")
    assert sorted(r["sequence"] for r in greedy_cooldown(rows, 0).collect()) == [1, 2, 3, 5]
    with pytest.raises(ValueError):
        greedy_cooldown(rows, -1)


def test_files_are_found_by_their_place_below_the_root(spark, tmp_path):
    receipts = []
    for name, content, said in (("events/1.json", b"[1]", b"[1]"), ("events/2.json", b"[2]", b"[3]"), ("lineups/1.json", b"[]", b"[]"), ("lineups/2.json", b"{}", None)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
        if said is not None:
            receipts.append({"relative_path": name, "sha256": hashlib.sha256(said).hexdigest(), "bytes": len(said), "kind": "events", "source_commit": "a", "provider_match_id": 1})
    receipts += [receipts[2], {**receipts[0], "relative_path": "events/3.json"}, {**receipts[0], "relative_path": "events/4.json", "sha256": None}]
    manifest = tmp_path / "manifest.jsonl"
    manifest.write_text("\n".join(map(json.dumps, receipts)))
    known = raw.read_manifest(spark, str(manifest))
    stored = raw.read_contents(spark, str(tmp_path)).where("relative_path <> 'manifest.jsonl'")
    found = {r["relative_path"]: r["outcome"] for r in raw.verify_contents(stored, known).collect()}
    assert found == {
        "events/1.json": "verified", "events/2.json": "mismatch", "events/3.json": "missing", "events/4.json": "incomplete receipt",
        "lineups/1.json": "repeated receipt", "lineups/2.json": "no receipt",
    }


def test_a_sixth_period_counts_like_the_fifth(spark):
    def stream(period):
        rows = [(1, 7, 7, s, s, period if s > 40 else 1, 60 * s if s <= 40 else 60 * (s - 41), "shot", False, s) for s in range(1, 80)]
        return spark.createDataFrame(rows, "match_id int, team_id int, possession_team_id int, sequence int, event_id int, period int, elapsed_seconds int, event_type string, penalty boolean, minute int")

    def seen(period):
        return sorted((r["sequence"], r["earlier_seconds"]) for r in detect.earlier_playing_seconds(stream(period)).collect())

    assert seen(5) == seen(6) and all(e is not None for _, e in seen(6))


def test_fingerprints_tell_awkward_values_apart(spark):
    def print_of(*rows):
        return lineage.fingerprint({"t": spark.createDataFrame(rows, "a string, b string")}).first()["content"]

    assert print_of(("a|b", "c")) != print_of(("a", "b|c"))
    assert print_of((None, "x")) != print_of(("\\N", "x")) and print_of(("N", None)) != print_of((None, "N"))
    assert print_of(("1", "2"), ("3", "4")) == print_of(("3", "4"), ("1", "2"))


def test_a_rewritten_table_is_read_again(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = inputs._files(spark, spark.read.parquet(str(tmp_path / "t")).inputFiles())
    spark.range(500).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert one != inputs._files(spark, spark.read.parquet(str(tmp_path / "t")).inputFiles())


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared_folder(Session())
