"""Nested provider files: explicit schemas, readers and contents checks. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMED = "struct<id:int,name:string>"
# The provider's field names.
EVENT_SCHEMA = f"""struct<id:string,index:int,period:int,timestamp:string,minute:int,second:int,type:{NAMED},
possession:int,possession_team:{NAMED},team:{NAMED},player:{NAMED},position:{NAMED},location:array<double>,
under_pressure:boolean,
pass:struct<end_location:array<double>,recipient:{NAMED},type:{NAMED},outcome:{NAMED},height:{NAMED},
cross:boolean,shot_assist:boolean,goal_assist:boolean>,
carry:struct<end_location:array<double>>,
shot:struct<statsbomb_xg:double,end_location:array<double>,outcome:{NAMED},type:{NAMED},body_part:{NAMED},key_pass_id:string>,
substitution:struct<replacement:{NAMED},outcome:{NAMED}>,
foul_committed:struct<card:{NAMED}>,bad_behaviour:struct<card:{NAMED}>,
tactics:struct<formation:string,lineup:array<struct<player:{NAMED}>>>>""".replace("\n", "")
LINEUP_SCHEMA = """array<struct<team_id:int,team_name:string,lineup:array<struct<player_id:int,player_name:string,
player_nickname:string,jersey_number:int,positions:array<struct<position_id:int,position:string,`from`:string,`to`:string,
from_period:int,to_period:int,start_reason:string,end_reason:string>>>>>>""".replace("\n", "")
MATCH_SCHEMA = """struct<match_id:bigint,match_date:string,kick_off:string,
competition:struct<competition_id:int,competition_name:string>,season:struct<season_id:int,season_name:string>,
home_team:struct<home_team_id:int,home_team_name:string>,away_team:struct<away_team_id:int,away_team_name:string>,
home_score:int,away_score:int,match_status:string,match_status_360:string,match_week:int,last_updated:string,
competition_stage:struct<name:string>,stadium:struct<name:string>,
metadata:struct<data_version:string,xy_fidelity_version:string,shot_fidelity_version:string>>""".replace("\n", "")
METADATA_FIELDS = ("data_version", "shot_fidelity_version", "xy_fidelity_version")
TERM = "struct<value:string>"
TENURE_SCHEMA = f"""struct<results:struct<bindings:array<struct<statement:{TERM},coach:{TERM},coachLabel:{TERM},start:{TERM},
startPrecision:{TERM},`end`:{TERM},endPrecision:{TERM},referenceUrl:{TERM}>>>>""".replace("\n", "")
RECEIPT_SCHEMA = """struct<provider:string,dataset:string,source_commit:string,relative_path:string,url:string,kind:string,
provider_match_id:bigint,sha256:string,bytes:bigint,retrieved_at:string,split_bucket:string>""".replace("\n", "")


def _match_id_of_file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"(?:match_id=|/)(\d+)(?:/[^/]*|\.json)$", 1).try_cast("bigint")


def read_records(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Raw JSON records with their file's match id, each record kept as recorded.

    The default is one JSON array per file. ``lines`` reads one record per line, which Spark
    can split, so a single match may be of any size.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    text = reader.text(path, wholetext=not lines).select(_match_id_of_file().alias("match_id"), "value")
    if lines:
        return text.select("match_id", F.col("value").alias("record"))
    return text.select("match_id", F.explode(F.from_json("value", "array<string>")).alias("record"))


def parse_events(records: DataFrame) -> DataFrame:
    """Columns match_id, record (as recorded) and e (typed)."""
    return records.select("match_id", "record", _parsed_once("record", EVENT_SCHEMA, "e"))


def _parsed_once(column: str, schema: str, name: str) -> Column:
    """Parse each text a single time.

    A plain ``from_json`` is repeated by the optimizer for every field a later filter or
    select touches; a generator of one element keeps it to one evaluation per row.
    """
    return F.explode(F.array(F.from_json(column, schema))).alias(name)


def read_events(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    return parse_events(read_records(spark, path, lines=lines))


def parse_lineups(documents: DataFrame) -> DataFrame:
    """Players of both teams with their positions. ``documents``: match_id, document."""
    teams = documents.select("match_id", F.explode(F.from_json("document", LINEUP_SCHEMA)).alias("t"))
    return teams.select("match_id", "t.team_id", "t.team_name", F.explode("t.lineup").alias("p"))


def read_lineups(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return parse_lineups(files.select(_match_id_of_file().alias("match_id"), F.col("value").alias("document")))


def parse_match_index(records: DataFrame) -> DataFrame:
    return records.select("record", _parsed_once("record", MATCH_SCHEMA, "m"))


def read_match_index(
    spark: SparkSession, path: str, wanted: DataFrame | None = None, *, lines: bool = False
) -> DataFrame:
    found = parse_match_index(read_records(spark, path, lines=lines).select("record"))
    if wanted is None:
        return found
    return found.join(wanted.select("match_id"), F.col("m.match_id") == F.col("match_id"), "left_semi")


def absent_matches(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ids no index file holds; any row must stop the caller."""
    return wanted.select("match_id").join(index.select(F.col("m.match_id").alias("match_id")), "match_id", "left_anti")


# --- manifests and file contents ----------------------------------------------------------


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Receipts of an append-only manifest, one JSON object per ``value``."""
    return lines.select(_parsed_once("value", RECEIPT_SCHEMA, "r")).select("r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def manifest_problems(receipts: DataFrame) -> DataFrame:
    """Paths recorded more than once, and records lacking what a check needs."""
    incomplete = (
        F.col("relative_path").isNull() | F.col("sha256").isNull() | F.col("bytes").isNull()
        | F.col("kind").isNull() | F.col("source_commit").isNull()
    )
    return (
        receipts.groupBy("relative_path")
        .agg(F.count("*").alias("records"), F.count_if(incomplete).alias("incomplete"))
        .where("records > 1 or incomplete > 0")
        .withColumn("reason", F.when(F.col("records") > 1, "duplicate path").otherwise("incomplete record"))
    )


def receipts_by_kind(receipts: DataFrame, source_commit: str, kinds=("events", "lineups")) -> DataFrame:
    """Paths per match and kind for one source version."""
    return (
        receipts.where((F.col("source_commit") == source_commit) & F.col("kind").isin(*kinds))
        .groupBy("provider_match_id")
        .pivot("kind", list(kinds))
        .agg(F.min("relative_path"))
    )


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with their place below it, as manifests have it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Readers write schemes in their own way (file:/a, file:///a); what counts is the path.
    root = path.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("relative_path"), "content")


def verify_contents(stored: DataFrame, receipts: DataFrame) -> DataFrame:
    """Compare stored bytes with their receipts, a row per path.

    Outcomes: verified, mismatch, missing, no receipt, repeated receipt (recorded more than once), incomplete receipt.
    """
    once = receipts.groupBy("relative_path").agg(F.count("*").alias("_records"), F.min("sha256").alias("sha256"), F.min("bytes").alias("bytes"))
    found = stored.select(
        "relative_path", F.sha2("content", 256).alias("found_sha256"), F.octet_length("content").alias("found_bytes")
    )
    same = (F.col("found_sha256") == F.col("sha256")) & (F.col("found_bytes") == F.col("bytes"))
    return found.join(once, "relative_path", "full").select(
        "relative_path",
        F.when(F.col("_records") > 1, "repeated receipt")
        .when(F.col("_records").isNull(), "no receipt")
        .when(F.col("sha256").isNull() | F.col("bytes").isNull(), "incomplete receipt")
        .when(F.col("found_sha256").isNull(), "missing")
        .when(same, "verified")
        .otherwise("mismatch")
        .alias("outcome"),
    )


def inventory_audit(stored: DataFrame, receipts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Problems between stored objects (relative_path, sha256, bytes) and allowed receipts; a path recorded twice is one."""
    once = receipts.groupBy("relative_path").agg(F.count("*").alias("_records"), *[F.min(c).alias(c) for c in ("sha256", "bytes", "provider_match_id")])
    known = once.join(
        allowed.select(F.col("match_id").alias("provider_match_id"), F.lit(True).alias("_allowed")), "provider_match_id", "left"
    ).select(
        "relative_path", F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes"), "provider_match_id", "_records",
        F.coalesce("_allowed", F.col("provider_match_id").isNull()).alias("_allowed"), F.lit(True).alias("_known"),
    )
    both = stored.withColumn("_stored", F.lit(True)).join(known, "relative_path", "full")
    differs = (F.col("sha256") != F.col("_sha")) | (F.col("bytes") != F.col("_bytes"))
    problem = (
        F.when(F.col("_records") > 1, "repeated receipt")
        .when(F.col("_stored").isNull(), F.when(F.col("_allowed"), "missing"))
        .when(F.col("_known").isNull(), "unexpected object")
        .when(~F.col("_allowed"), "held-out match file")
        .when(differs, "size or checksum differs")
    )
    return both.select("relative_path", problem.alias("problem")).where("problem is not null")


# --- saved query results ------------------------------------------------------------------


def parse_tenures(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tenure candidates and rejected bindings. ``documents``: team_entity, document.

    Dates keep their precision; a date without one is rejected, never completed.
    """
    b = documents.select(
        "team_entity", F.posexplode(F.from_json("document", TENURE_SCHEMA)["results"]["bindings"]).alias("position", "b")
    )
    value = lambda name: F.col(f"b.{name}.value")
    entity = F.regexp_extract(value("coach"), r"^https?://www\.wikidata\.org/entity/(Q[1-9][0-9]*)$", 1)
    statement = r"^https?://www\.wikidata\.org/entity/statement/"
    digits = lambda name: value(name).isNotNull() & ~value(name).rlike("^[0-9]+$")
    unpaired = lambda d: value(d).isNull() != value(f"{d}Precision").isNull()
    reason = (
        F.when(~F.col("team_entity").rlike("^Q[1-9][0-9]*$"), "invalid team entity")
        .when(value("coach").isNull(), "missing coach binding")
        .when(entity == "", "coach binding is not an item")
        .when(value("statement").isNull(), "missing statement binding")
        .when(~value("statement").rlike(statement), "statement binding is not a statement")
        .when(digits("startPrecision") | digits("endPrecision"), "invalid precision value")
        .when(unpaired("start") | unpaired("end"), "tenure date lacks its precision")
    )
    rows = b.withColumn("reason", reason)
    good = rows.where("reason is null").select(
        "team_entity",
        entity.alias("coach_entity"),
        F.coalesce(value("coachLabel"), entity).alias("coach_label"),
        value("statement").alias("statement_url"),
        value("start").alias("start_value"),
        value("startPrecision").cast("int").alias("start_precision"),
        value("end").alias("end_value"),
        value("endPrecision").cast("int").alias("end_precision"),
        value("referenceUrl").alias("reference_url"),
    )
    return good, rows.where("reason is not null").select("team_entity", "position", "reason")
