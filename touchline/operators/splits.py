"""Chronological splits, review samples and the refusal of held-out matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.lineage import fingerprint

SEASON = ["competition_id", "season_id"]
BUCKETS = ("development", "validation", "test")


def chronological_split(matches: DataFrame) -> DataFrame:
    """Whole dates, 70/15/15 per season: the pair of cut dates with the smallest total error.

    A season is first reduced to one row per date. The error is a sum of one term per cut,
    so for every second cut only the best earlier first cut counts: a running minimum over
    the dates replaces comparing all pairs of dates.
    """
    daily = matches.groupBy(*SEASON, "match_date").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*SEASON).orderBy("match_date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    season = Window.partitionBy(*SEASON)
    dated = daily.withColumns(
        {
            "i": F.row_number().over(order) - 1,
            "c": F.sum("n").over(upto),
            "total": F.sum("n").over(season),
            "dates": F.count("*").over(season),
        }
    )
    error = lambda percent: F.abs(100 * F.col("c") - percent * F.col("total"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    best_first = F.min(F.struct(error(70).alias("e"), F.col("i").alias("i"))).over(before)
    pairs = dated.withColumn("first", best_first).where((F.col("first").isNotNull()) & (F.col("i") < F.col("dates") - 1))
    best = pairs.groupBy(*SEASON).agg(
        F.min(F.struct((F.col("first.e") + error(85)).alias("e"), F.col("first.i").alias("first"), F.col("i").alias("second"))).alias("cut")
    )
    index = F.col("i")
    bucket = (
        F.when(index <= F.col("cut.first"), BUCKETS[0]).when(index <= F.col("cut.second"), BUCKETS[1]).otherwise(BUCKETS[2])
    )
    labelled = dated.join(best, SEASON).select(*SEASON, "match_date", bucket.alias("bucket"))
    return matches.join(labelled, [*SEASON, "match_date"])


def short_seasons(matches: DataFrame) -> DataFrame:
    """Seasons with fewer than three distinct dates; these cannot be split."""
    dates = matches.groupBy(*SEASON, "match_date").agg(F.lit(1).alias("_one")).groupBy(*SEASON).agg(F.count("*").alias("dates"))
    return dates.where("dates < 3")


def promote_inspected(split: DataFrame, inspected: DataFrame) -> DataFrame:
    """Move the whole date of an inspected match to development and say why."""
    marked = split.join(inspected.select("match_id", F.lit(True).alias("_seen")), "match_id", "left")
    days = marked.where("_seen").select(*SEASON, "match_date", F.lit(True).alias("_day")).distinct()
    moved = marked.join(days, [*SEASON, "match_date"], "left")
    label = F.when(F.col("_seen"), "already_inspected").when(
        F.col("_day") & (F.col("bucket") != "development"), "same_date_as_inspected"
    )
    return moved.select(
        *[c for c in split.columns if c != "bucket"],
        F.when(F.col("_day"), "development").otherwise(F.col("bucket")).alias("bucket"),
        label.alias("development_exception"),
    )


def emptied_buckets(split: DataFrame) -> DataFrame:
    """Seasons that lost a bucket to promotions; any row must stop the caller."""
    present = split.groupBy(*SEASON, "bucket").agg(F.lit(1).alias("_one")).groupBy(*SEASON).agg(F.count("*").alias("buckets"))
    return present.where(F.col("buckets") < len(BUCKETS))


def review_rank(seed: int, provider: str) -> Column:
    text = F.concat_ws(
        ":", F.lit(str(seed)), F.lit(provider), *[F.col(c).cast("string") for c in (*SEASON, "match_id")]
    )
    return F.sha2(text, 256)


def review_sample(split: DataFrame, core_seasons: DataFrame, *, seed: int, provider: str = "provider", size: int = 6) -> DataFrame:
    """The ``size`` validation matches with the lowest hash in each core season.

    Each block keeps its own lowest rows first, so no season is ranked whole in one task.
    """
    rows = (
        split.where("bucket = 'validation'")
        .join(core_seasons.select(*SEASON), SEASON, "left_semi")
        .select(*SEASON, "match_id", review_rank(seed, provider).alias("rank_hash"))
    )
    part = rows.withColumn("_part", F.col("match_id") % 256)
    order = ["rank_hash", "match_id"]
    local = Window.partitionBy(*SEASON, "_part").orderBy(*order)
    small = part.withColumn("_n", F.row_number().over(local)).where(F.col("_n") <= size)
    place = F.row_number().over(Window.partitionBy(*SEASON).orderBy(*order))
    return small.withColumn("place", place).where(F.col("place") <= size).select(*SEASON, "match_id", "place")


def select_development(split: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted development matches, and the refused ids (held out or unknown)."""
    good = split.where("bucket = 'development'").select("match_id")
    asked = wanted.select("match_id").distinct()
    known = split.select("match_id", "bucket")
    refused = asked.join(good, "match_id", "left_anti").join(known, "match_id", "left")
    return asked.join(good, "match_id", "left_semi"), refused.select("match_id", F.coalesce("bucket", F.lit("unknown")).alias("reason"))


def verify_split(computed: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows only one of the two has; empty when the frozen file still holds."""
    columns = frozen.columns
    only = lambda a, b, label: a.select(*columns).exceptAll(b.select(*columns)).withColumn("only_in", F.lit(label))
    return only(computed, frozen, "computed").unionByName(only(frozen, computed, "frozen"))


def leak_check(matches: DataFrame, split: DataFrame) -> DataFrame:
    """Matches not known to be development, unknown ones included."""
    joined = matches.select("match_id").join(split.select("match_id", "bucket"), "match_id", "left")
    return joined.where(~F.col("bucket").eqNullSafe("development"))


class SplitArchive:
    """Frozen splits: append-only numbered versions, each named by its content, so an edited one is found out when it is read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> dict[int, str]:
        """Number and content name of each version, from the folder names."""
        path, fs = self._fs(self.root)
        if not fs.exists(path):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return {int(n.split("-")[1]): n.split("-")[2] for n in sorted(names) if n.startswith("version-")}

    @staticmethod
    def _content(split: DataFrame) -> str:
        row = fingerprint({"split": split.select("match_id", "bucket")}).first()
        return f"{row['rows']}x{row['content']}"

    def freeze(self, split: DataFrame) -> int:
        """Store ``split`` as the next version; the newest version's own content again stores nothing. Raises where the number was taken."""
        rows, known = split.select("match_id", "bucket"), self.versions()
        content, last = self._content(rows), max(known, default=0)
        if known.get(last) == content:
            return last
        path, _ = self._fs(f"{self.root}/version-{last + 1:06d}-{content}")
        rows.sort("match_id").write.mode("errorifexists").parquet(path.toString())
        if sum(n == last + 1 for n in (int(v.split("-")[1]) for v in self._names())) > 1:
            raise RuntimeError(f"version {last + 1} was frozen by another writer as well")
        return last + 1

    def _names(self) -> list[str]:
        path, fs = self._fs(self.root)
        return [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("version-")]

    def read(self, version: int) -> DataFrame:
        """A frozen split; raises if its rows are no longer those it is named by."""
        content = self.versions()[version]
        rows = self.spark.read.parquet(f"{self.root}/version-{version:06d}-{content}")
        if self._content(rows) != content:
            raise ValueError(f"version {version} was edited")
        return rows

    def verify(self, computed: DataFrame, version: int) -> DataFrame:
        """Rows that only the computed split or only the frozen one has."""
        return verify_split(computed, self.read(version))
