"""Derived layers of accepted matches: rebuilt match by match, published by one manifest.

A layer is a table partitioned by ``part``, a hash of the match, so a hot match stays one file set and many small ones share theirs.
``refresh`` compares each match's content, gate status and definition with what the layer was built from and builds only matches
that are new or changed; other matches of the same parts are copied, other parts stay where they are. Everything is written to a
place of its own first. A layer changes when the next manifest appears, in one step and under a number nobody else took; a write
that breaks leaves the old manifest, and with it the old layer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.lineage import content_hash, shown_values

PARTS = 16
PART = T.StructField("part", T.IntegerType())


@dataclass(frozen=True)
class Layer:
    """``build(only)`` makes the rows; ``only(df)`` keeps the rows of ``df`` whose match is built now. ``order`` sorts inside a part."""

    build: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]
    order: tuple[str, ...] = ("match_id",)
    version: int = 1


def match_digests(rows: DataFrame, key: str = "match_id") -> DataFrame:
    """Order-free content of each match: rows, and two sums over row hashes. A hot match is summed before the shuffle."""
    columns = sorted(rows.columns)
    one = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    two = F.xxhash64(F.lit(7), *[F.col(f"`{c}`") for c in columns])
    wide = lambda c: F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    return rows.groupBy(key).agg(F.concat_ws(":", F.count("*").cast("string"), wide(one), wide(two)).alias("digest"))


def part_of(match: str = "match_id", parts: int = PARTS):
    return F.pmod(F.xxhash64(F.col(match)), F.lit(parts)).cast("int")


class Warehouse:
    """Layers under ``root``, which all executors reach. The number of parts is fixed when a root is first used."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self.parts = spark, root, parts

    # --- manifests ---

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs(f"{self.root}/_manifest")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; an empty one before the first."""
        known = self.versions()
        if not known:
            return {"version": 0, "layers": {}}
        path = f"{self.root}/_manifest/{version or known[-1]:08d}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        """Create the next manifest; raises where another writer was first. The file is complete before it gets its name."""
        path, fs = self._fs(f"{self.root}/_manifest/{manifest['version']:08d}.json")
        draft, _ = self._fs(f"{self.root}/_manifest/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        if fs.exists(path) or not fs.rename(draft, path):
            raise RuntimeError(f"manifest {manifest['version']} was published by another writer")

    # --- reading ---

    def _table(self, name: str, entry: dict) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        paths = [p["path"] for _, p in sorted(entry["parts"].items(), key=lambda kv: int(kv[0]))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(T.StructType([*schema.fields, PART])).option("basePath", f"{self.root}/{name}")
        return read.parquet(*[f"{self.root}/{name}/{p}" for p in paths])

    def read(self, name: str, matches: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """A published layer; with ``matches`` only theirs, and only parts that can hold them are read."""
        entry = self.manifest(version)["layers"][name]
        rows = self._table(name, entry)
        if matches is not None and "part" in rows.columns:
            asked = matches.select("match_id", part_of(parts=entry["of"]).alias("part")).distinct()
            rows = rows.join(asked, ["part", "match_id"], "left_semi")
        return rows.select(*T.StructType.fromJson(entry["schema"]).names)

    def contents(self, version: int | None = None) -> DataFrame:
        """``table_name``, ``definition_version``, ``rows``, ``content``, ``parts`` of each layer as the manifest has them."""
        rows = []
        for name, e in self.manifest(version)["layers"].items():
            held = e["parts"].values()
            rows.append((name, e["version"], sum(p["rows"] for p in held), str(sum(int(p["content"]) for p in held)), len(held)))
        return self.spark.createDataFrame(rows, "table_name string, definition_version int, rows bigint, content string, parts int")

    # --- building ---

    def refresh(self, statuses: DataFrame, digests: DataFrame, layers: Mapping[str, Layer], run_id: str) -> dict[str, int]:
        """Bring ``layers`` up to date and publish. ``statuses``: match_id, dq_status; ``digests``: match_id, digest.

        Matches that are excluded, gone or without a status leave every layer. Returns how many matches each layer built or dropped.
        """
        manifest = self.manifest()
        accepted = digests.join(statuses.where("dq_status <> 'excluded'"), "match_id").select("match_id", "digest", "dq_status")
        state_path = f"_state/{uuid.uuid4().hex}"
        accepted.write.parquet(f"{self.root}/{state_path}")
        now = self.spark.read.schema(accepted.schema).parquet(f"{self.root}/{state_path}")
        entries, done = dict(manifest["layers"]), {}
        for name, layer in layers.items():
            old = entries.get(name)
            if old and (old["version"] != layer.version or old["of"] != self.parts):
                old = None
            before = self.spark.read.schema(now.schema).parquet(f"{self.root}/{old['state']}") if old else now.where("false")
            was = before.select("match_id", F.struct("digest", "dq_status").alias("_was"))
            turned = now.select("match_id", F.struct("digest", "dq_status").alias("_now")).join(was, "match_id", "full")
            turned = turned.where(~F.col("_was").eqNullSafe(F.col("_now"))).select("match_id", F.col("_now").isNotNull().alias("built"), part_of(parts=self.parts).alias("part"))
            turned_path = f"{self.root}/_state/{uuid.uuid4().hex}"
            turned.write.parquet(turned_path)
            turned = self.spark.read.schema(turned.schema).parquet(turned_path)
            touched = {r["part"]: r["n"] for r in turned.groupBy("part").agg(F.count("*").alias("n")).collect()}
            done[name] = sum(touched.values())
            if old and not touched:
                continue
            entries[name] = self._rebuild(name, layer, old, turned, set(touched), run_id) | {"state": state_path}
        if any(done.values()) or entries.keys() != manifest["layers"].keys():
            self._publish({"version": manifest["version"] + 1, "run_id": run_id, "layers": entries})
        return done

    def _rebuild(self, name: str, layer: Layer, old: dict | None, turned: DataFrame, touched: set[int], run_id: str) -> dict:
        keys = turned.where("built").select("match_id")
        made = layer.build(lambda df: df.join(keys, "match_id", "left_semi"))
        made = made.withColumns({"definition_version": F.lit(layer.version), "ingest_run_id": F.lit(run_id)})
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in made.schema.fields])
        rows = made
        stays = {k: p for k, p in old["parts"].items() if int(k) not in touched} if old else {}
        if old:
            copied = self._table(name, old | {"parts": {k: p for k, p in old["parts"].items() if int(k) in touched}})
            rows = rows.unionByName(copied.join(turned.select("match_id"), "match_id", "left_anti").select(*schema.names))
        version = f"version=v{uuid.uuid4().hex}"
        placed = rows.withColumn("part", part_of(parts=self.parts))
        # By order inside a part, so a match with a large share of the rows is spread over several files and tasks.
        by = ["part", *layer.order]
        placed.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("part").parquet(f"{self.root}/{name}/{version}")
        written = self.spark.read.schema(T.StructType([*schema.fields, PART])).parquet(f"{self.root}/{name}/{version}")
        content = content_hash(shown_values([f for f in schema.fields if f.name != "ingest_run_id"]))
        found = written.groupBy("part").agg(F.count("*").alias("rows"), F.sum(content).cast("decimal(38,0)").cast("string").alias("content")).collect()
        fresh = {str(r["part"]): {"path": f"{version}/part={r['part']}", "rows": r["rows"], "content": r["content"]} for r in found}
        return {"schema": json.loads(schema.json()), "version": layer.version, "of": self.parts, "parts": stays | fresh}
