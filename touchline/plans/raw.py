"""Queries for sources, normalization and quality, over documents built from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import clock as KC
from touchline.operators import catalog as CT
from touchline.operators import normalize as N
from touchline.operators import quality as Q
from touchline.plans.inputs import Inputs, landed
from touchline.plans.registry import num, nums, part, query
from touchline.session import new_folder
from touchline.sources import raw as R


# Which provider record each bridged event becomes. A few are broken on purpose.
def record_type(unknown: str) -> str:
    return f"""case when {unknown} then 'Mystery' when event_id % 10 = 0 and event_type = 'ball_recovery' then 'Substitution'
  when event_id % 10 = 3 and event_type = 'ball_recovery' then 'Starting XI' when event_id % 10 = 6 and event_type = 'ball_recovery' then 'Tactical Shift'
  when event_type = 'ball_recovery' then 'Ball Recovery' when event_id % 50 = 7 and event_type = 'pressure' then 'Own Goal For'
  when event_type = 'pressure' then 'Pressure' when event_type = 'pass' then 'Pass' when event_type = 'carry' then 'Carry' else 'Shot' end"""


# Behind the gate only every fifth match has unknown types, so that some matches are accepted; the rejects look at unknown types of all.
TYPE = record_type("event_id % 211 = 5 and match_id % 5 = 4")
EVERY_TYPE = record_type("event_id % 211 = 5")
PASS_TYPE = "case when not open_play then 'Corner' when event_id % 3 = 0 then 'Recovery' end"
SHOT_TYPE = "case when penalty then 'Penalty' when open_play then 'Open Play' else 'Free Kick' end"
FORMATION = "case event_id % 3 when 0 then '442' when 1 then '433' else '352' end"
ACTION = f"""case when {TYPE} in ('Substitution') then 'substitution' when {TYPE} in ('Starting XI', 'Tactical Shift') then 'formation_change'
  when {TYPE} = 'Own Goal For' then 'other' else event_type end"""


class Documents:
    """Provider-shaped JSON built by Spark from the bridge."""

    def __init__(self, i: Inputs, kind: str = TYPE):
        self.i, self.kind = i, kind

    @cached_property
    def records(self) -> DataFrame:
        named = lambda id_, name: F.struct(id_.alias("id"), name.alias("name"))
        text = lambda expression: F.expr(expression)
        kind, p = F.col("_type"), F.col("player_id")
        label = lambda c: F.when(c.isNotNull(), named(F.lit(1), c))
        player = lambda c: named(c, F.concat(F.lit("Player "), c.cast("string")))
        ends = F.array("end_x", "end_y")
        clock = F.format_string("00:%02d:%02d.%03d", F.col("minute"), F.col("second"), (F.col("event_id") % 1000).cast("int"))
        lineup = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda n: F.struct(player(n).alias("player")))
        team = named(F.col("team_id"), F.when(F.col("team_id") == 1, "Rovers").otherwise("City"))
        fields = [
            F.col("event_id").cast("string").alias("id"), F.col("sequence").alias("index"), "period", clock.alias("timestamp"),
            "minute", "second", label(kind).alias("type"), "possession", team.alias("possession_team"), team.alias("team"),
            player(p).alias("player"), F.array("x", "y").alias("location"),
            F.when(F.col("event_id") % 4 == 0, True).alias("under_pressure"),
            F.when(
                kind == "Pass",
                F.struct(
                    ends.alias("end_location"), player(p + 1).alias("recipient"), label(text(PASS_TYPE)).alias("type"),
                    label(F.when(~F.col("completed"), F.lit("Incomplete"))).alias("outcome"), label(F.lit("Ground Pass")).alias("height"),
                    F.when(F.col("event_id") % 6 == 0, True).alias("cross"),
                ),
            ).alias("pass"),
            F.when(kind == "Carry", F.struct(ends.alias("end_location"))).alias("carry"),
            F.when(
                kind == "Shot",
                F.struct(
                    F.when(F.col("event_id") % 17 != 0, F.col("provider_xg").cast("double")).alias("statsbomb_xg"),
                    F.when(F.col("event_id") % 2 == 0, ends).otherwise(F.array("end_x", "end_y", F.lit(1.5))).alias("end_location"),
                    label(F.when(F.col("scores_goal"), F.lit("Goal")).otherwise("Saved")).alias("outcome"), label(text(SHOT_TYPE)).alias("type"),
                    label(F.lit("Head")).alias("body_part"),
                ),
            ).alias("shot"),
            F.when(kind == "Substitution", F.struct(player(p + 100).alias("replacement"), label(F.lit("Tactical")).alias("outcome"))).alias("substitution"),
            F.when(
                kind.isin("Starting XI", "Tactical Shift"),
                F.struct(F.expr(FORMATION).cast("int").alias("formation"), F.when(kind == "Starting XI", lineup).alias("lineup")),
            ).alias("tactics"),
        ]
        rows = self.i.events.withColumn("_type", F.expr(self.kind))
        return rows.select("match_id", F.to_json(F.struct(*fields)).alias("record"))

    @cached_property
    def parsed(self) -> DataFrame:
        return R.parse_events(self.records)

    @cached_property
    def events(self) -> DataFrame:
        return N.normalize_events(self.parsed)

    @cached_property
    def lineups(self) -> DataFrame:
        """One document per match; a squad is at most twenty players per team here."""
        p = F.col("player_id")
        clock = lambda seconds: F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))
        spells = self.i.spells.withColumn(
            "position",
            F.struct(
                (p % 11).cast("int").alias("position_id"), F.lit("Wing").alias("position"),
                clock(F.col("start_seconds")).alias("from"),
                F.when(
                    F.col("end_period").isNotNull(),
                    clock(F.col("end_seconds") + F.coalesce(KC.period_start_seconds("end_period"), F.lit(0))),
                ).alias("to"),
                F.col("start_period").alias("from_period"), F.col("end_period").alias("to_period"),
                F.when((p <= 12) & (F.col("spell_number") == 1), "Starting XI").otherwise("Tactical Shift").alias("start_reason"),
                F.lit("Final Whistle").alias("end_reason"), "spell_number",
            ),
        )
        players = spells.groupBy("match_id", "team_id", "player_id").agg(
            F.array_sort(F.collect_list(F.struct(F.col("position.spell_number").alias("n"), "position"))).alias("ps")
        )
        member = F.struct(
            "player_id", F.concat(F.lit("Player "), p.cast("string")).alias("player_name"),
            (p % 30).cast("int").alias("jersey_number"), F.transform("ps", lambda s: s["position"]).alias("positions"),
        )
        teams = players.groupBy("match_id", "team_id").agg(F.sort_array(F.collect_list(member)).alias("lineup"))
        team = F.struct("team_id", F.when(F.col("team_id") == 1, "Rovers").otherwise("City").alias("team_name"), "lineup")
        return teams.groupBy("match_id").agg(F.to_json(F.sort_array(F.collect_list(team))).alias("document"))

    @cached_property
    def players(self) -> DataFrame:
        return R.parse_lineups(self.lineups)

    @cached_property
    def index_records(self) -> DataFrame:
        """Match index records from ``orders``: one match per order."""
        key = F.col("o_orderkey")
        comp, season = (key % 5).cast("int"), (key % 3).cast("int")
        team = lambda side, k: F.struct(
            k.cast("int").alias(f"{side}_team_id"), F.concat(F.lit("Team "), k.cast("string")).alias(f"{side}_team_name")
        )
        fields = [
            key.alias("match_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("match_date"),
            F.when(key % 29 == 0, "20:00:00Z").otherwise("20:00:00.000").alias("kick_off"),
            F.struct(comp.alias("competition_id"), F.concat(F.lit("Cup "), comp.cast("string")).alias("competition_name")).alias("competition"),
            F.struct(season.alias("season_id"), F.concat(F.lit("Year "), season.cast("string")).alias("season_name")).alias("season"),
            team("home", F.col("o_custkey")).alias("home_team"), team("away", F.col("o_custkey") + 1).alias("away_team"),
            (key % 4).cast("int").alias("home_score"), (key % 3).cast("int").alias("away_score"),
            F.when(key % 31 == 0, "deleted").otherwise("available").alias("match_status"),
            F.when(key % 2 == 0, "available").when(key % 37 == 0, "odd").alias("match_status_360"),
            (key % 38).cast("int").alias("match_week"), F.when(key % 5 != 0, "2024-01-01T00:00:00").alias("last_updated"),
            F.when(key % 3 == 0, F.struct(F.lit("Final").alias("name"))).alias("competition_stage"),
            F.struct(
                F.when(key % 6 == 0, "1.1.0").otherwise(" ").alias("data_version"), F.when(key % 7 != 0, "2").alias("xy_fidelity_version"),
                F.lit("2").alias("shot_fidelity_version"),
            ).alias("metadata"),
        ]
        return self.i.table("orders").select(F.to_json(F.struct(*fields)).alias("record"))

    @cached_property
    def index(self) -> DataFrame:
        return R.parse_match_index(self.index_records)

    @cached_property
    def choices(self) -> DataFrame:
        """Season choices from ``nation``; some are wrong on purpose."""
        key = F.col("n_nationkey")
        return self.i.table("nation").select(
            F.when(key == 24, 0).otherwise(F.expr("n_nationkey % 6")).cast("int").alias("competition_id"),
            F.expr("n_nationkey div 6").cast("int").alias("season_id"),
            F.when(key % 2 == 0, "core_breadth").when(key % 9 == 0, "odd").otherwise("modern_robustness").alias("role"),
            F.when(key % 4 == 0, "tournament").when(key % 10 == 3, "odd").otherwise("complete_season").alias("coverage"),
            (key * 70 - 70).cast("int").alias("expected_matches"), (key - 2).cast("int").alias("known_missing_matches"),
        )

    @cached_property
    def stored(self) -> DataFrame:
        """``documents`` as stored files; every thirteenth is gone."""
        return self.i.table("documents").where("doc_id % 13 <> 0").select(
            F.concat(F.lit("data/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("relative_path"),
            F.encode("text", "UTF-8").alias("content"),
        )

    @cached_property
    def receipt_lines(self) -> DataFrame:
        key = F.col("doc_id")
        sha = F.sha2(F.encode("text", "UTF-8"), 256)
        receipt = F.struct(
            F.lit("provider").alias("provider"), F.lit("open").alias("dataset"),
            F.when(key % 5 == 0, "old").otherwise("new").alias("source_commit"),
            F.concat(F.lit("data/"), F.when(key % 101 == 0, key + 1).otherwise(key).cast("string"), F.lit(".json")).alias("relative_path"),
            F.when(key % 2 == 0, "events").otherwise("lineups").alias("kind"), F.expr("doc_id div 2").alias("provider_match_id"),
            F.when(key % 11 == 0, "00").when(key % 103 == 0, None).otherwise(sha).alias("sha256"),
            F.octet_length(F.encode("text", "UTF-8")).alias("bytes"),
        )
        return self.i.table("documents").where("doc_id % 7 <> 0").select(F.to_json(receipt).alias("value"))

    @cached_property
    def receipts(self) -> DataFrame:
        return R.parse_manifest(self.receipt_lines)


def write_by_match(records: DataFrame, path: str) -> None:
    """A folder of lines for each match. Matches are dealt by range first, so a match has one file, or a few if it is very large."""
    records.repartitionByRange("match_id", F.xxhash64("record")).write.partitionBy("match_id").text(path)


def documents(i: Inputs) -> Documents:
    if not hasattr(i, "_documents"):
        i._documents = Documents(i)
    return i._documents


# --- SQL parts ----------------------------------------------------------------------------

part("typed", f"select *, {TYPE} as provider_type, {PASS_TYPE} as pt, {SHOT_TYPE} as st, {FORMATION} as fm from me")
part("nev", f"""select *, {ACTION} as action, cast(sec0 + (event_id % 1000) / 1000e0 as decimal(8,3)) as ts from
  (select *, minute * 60 + second as sec0 from typed where provider_type <> 'Mystery')""")
part("rcp", """select 'data/' || cast(case when doc_id % 101 = 0 then doc_id + 1 else doc_id end as varchar) || '.json' as relative_path,
  case when doc_id % 2 = 0 then 'events' else 'lineups' end as kind, doc_id // 2 as provider_match_id, case when doc_id % 5 = 0 then 'old' else 'new' end as source_commit,
  case when doc_id % 11 = 0 then '00' when doc_id % 103 = 0 then null else sha256(text) end as sha256, octet_length(encode(text)) as bytes from documents where doc_id % 7 <> 0""")
part("sto", "select 'data/' || cast(doc_id as varchar) || '.json' as relative_path, sha256(text) as s, octet_length(encode(text)) as n from documents where doc_id % 13 <> 0")
part("oidx", """select o_orderkey as match_id, cast(o_orderkey % 5 as int) as competition_id, cast(o_orderkey % 3 as int) as season_id, o_orderkey as k, o_orderdate, o_custkey,
  case when o_orderkey % 29 = 0 then 'k' when o_orderkey % 31 = 0 then 's' when o_orderkey % 2 <> 0 and o_orderkey % 37 = 0 then 'f' end as problem,
  (case when o_orderkey % 6 = 0 then '1.1.0' else ' ' end) as dv from orders""")
part("cho", """select cast(case when n_nationkey = 24 then 0 else n_nationkey % 6 end as int) as competition_id, cast(n_nationkey // 6 as int) as season_id,
  case when n_nationkey % 2 = 0 then 'core_breadth' when n_nationkey % 9 = 0 then 'odd' else 'modern_robustness' end as role,
  case when n_nationkey % 4 = 0 then 'tournament' when n_nationkey % 10 = 3 then 'odd' else 'complete_season' end as coverage,
  cast(n_nationkey * 70 - 70 as int) as expected_matches, cast(n_nationkey - 2 as int) as known_missing_matches from nation""")

# --- A: sources ---------------------------------------------------------------------------


@query("a1_read_events", "select match_id, cast(event_id as varchar) as id, sequence as index_number, period, provider_type, case when provider_type = 'Mystery' then null else action end as action from (select *, " + ACTION + " as action from typed)")
def _(i: Inputs):
    path = new_folder(i.spark, "events")
    write_by_match(documents(i).records, path)
    parsed = N.checked_events(R.read_events(i.spark, path, lines=True))
    return parsed.select(
        "match_id", F.col("e.id").alias("id"), F.col("e.index").alias("index_number"), F.col("e.period").alias("period"),
        F.col("e.type.name").alias("provider_type"),
        F.when(F.col("e.type.name") == "Mystery", F.lit(None)).otherwise(F.col("_action")).alias("action"),
    )


@query("a2_read_lineups", "select match_id, team_id, player_id, 'Player ' || player_id as player_name, cast(case when player_id % 4 < 2 then 2 else 1 end as int) as positions from pl")
def _(i: Inputs):
    path = new_folder(i.spark, "lineups")
    documents(i).lineups.select("match_id", F.col("document")).write.partitionBy("match_id").text(path)
    return R.read_lineups(i.spark, path).select("match_id", "team_id", "p.player_id", "p.player_name", F.size("p.positions").alias("positions"))


@query("a3_read_match_index", "select match_id, competition_id, season_id, strftime(o_orderdate, '%Y-%m-%d') as match_date from oidx where exists (select 1 from lineitem where l_orderkey + 3 = match_id)")
def _(i: Inputs):
    path = new_folder(i.spark, "index")
    documents(i).index_records.withColumn("season", F.expr("get_json_object(record, '$.season.season_id')")).write.partitionBy("season").text(path)
    wanted = i.table("lineitem").select((F.col("l_orderkey") + 3).alias("match_id")).distinct()
    m = lambda p: F.col(f"m.{p}")
    return R.read_match_index(i.spark, path, wanted, lines=True).select(
        m("match_id").alias("match_id"), m("competition.competition_id").alias("competition_id"), m("season.season_id").alias("season_id"), m("match_date").alias("match_date"),
    )


@query("a3_absent_matches", "select distinct l_orderkey + 3 as match_id from lineitem where l_orderkey + 3 not in (select o_orderkey from orders)")
def _(i: Inputs):
    wanted = i.table("lineitem").select((F.col("l_orderkey") + 3).alias("match_id")).distinct()
    return R.absent_matches(documents(i).index, wanted)


@query("a4_season_choices_check", """select competition_id, season_id, 'unknown role' as problem from cho where role = 'odd' union all
  select competition_id, season_id, 'unknown coverage' from cho where coverage = 'odd' union all
  select competition_id, season_id, 'expected matches must be at least 1' from cho where expected_matches < 1 union all
  select competition_id, season_id, 'known missing matches must not be negative' from cho where known_missing_matches < 0 union all
  select competition_id, season_id, 'season chosen twice' from cho group by 1, 2 having count(*) > 1""")
def _(i: Inputs):
    return CT.season_choices_check(documents(i).choices)


part("seas", """select o.competition_id, o.season_id, count(*) as matches, count(*) filter (where o.problem is not null) as bad,
  count(*) filter (where match_id % 2 = 0) as frames, count(*) filter (where match_id % 7 = 0) as mm from oidx o group by 1, 2""")


@query("a5_catalog_check", """select competition_id, season_id, unnest(list_filter([case when matches is null then 'season is absent from the index' end,
   case when expected_matches is null then 'match belongs to a season that was not chosen' end,
   case when matches <> expected_matches then 'expected ' || expected_matches || ' matches, got ' || matches end,
   case when bad > 0 then bad || ' unusable matches' end], lambda p: p is not null)) as problem
  from seas full join cho using (competition_id, season_id)""")
def _(i: Inputs):
    return CT.catalog_check(documents(i).index, documents(i).choices)


@query("a6_catalog_season_summary", """select competition_id, season_id, role, coverage, coalesce(matches, 0) as matches, coalesce(frames, 0) as with_frames,
  coalesce(mm, 0) as missing_metadata, expected_matches - coalesce(matches, 0) as gap, known_missing_matches from cho left join seas using (competition_id, season_id)""")
def _(i: Inputs):
    return CT.catalog_season_summary(documents(i).index, documents(i).choices)


OUTCOME = """case when records > 1 then 'repeated receipt' when records is null then 'no receipt' when sha256 is null or bytes is null then 'incomplete receipt'
  when s is null then 'missing' when s = sha256 and n = bytes then 'verified' else 'mismatch' end"""
part("rcps", "select relative_path, count(*) as records, min(sha256) as sha256, min(bytes) as bytes, min(provider_match_id) as provider_match_id from rcp group by 1")


@query("a7_verify_files", f"select relative_path, {OUTCOME} as outcome from sto full join rcps using (relative_path)")
def _(i: Inputs):
    return R.verify_contents(documents(i).stored, documents(i).receipts)


@query("a8_read_manifest", """select relative_path, count(*) as records, count(*) filter (where sha256 is null) as incomplete,
  case when count(*) > 1 then 'duplicate path' else 'incomplete record' end as reason from rcp group by 1 having count(*) > 1 or count(*) filter (where sha256 is null) > 0""")
def _(i: Inputs):
    return R.manifest_problems(documents(i).receipts)


@query("a9_receipts_by_kind", "select provider_match_id, min(relative_path) filter (where kind = 'events') as events, min(relative_path) filter (where kind = 'lineups') as lineups from rcp where source_commit = 'new' group by 1")
def _(i: Inputs):
    return R.receipts_by_kind(documents(i).receipts, "new")


@query("a10_inventory_audit", """select * from (select relative_path, case when records > 1 then 'repeated receipt' when s is null then case when provider_match_id % 3 <> 0 then 'missing' end
   when provider_match_id is null then 'unexpected object' when provider_match_id % 3 = 0 then 'held-out match file' when s <> sha256 or n <> bytes then 'size or checksum differs' end as problem
  from sto full join rcps using (relative_path)) where problem is not null""")
def _(i: Inputs):
    d = documents(i)
    stored = d.stored.select("relative_path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"))
    allowed = i.table("documents").select(F.expr("doc_id div 2").alias("match_id")).distinct().where("match_id % 3 <> 0")
    return R.inventory_audit(stored, d.receipts, allowed)


part("cust", """select c_custkey, 'Q' || (c_custkey + 1) as coach, case when c_custkey % 7 <> 0 then '2020-01-01T00:00:00Z' end as st,
  case when c_custkey % 7 <> 0 and c_custkey % 11 <> 0 then '9' when c_custkey % 13 = 0 then 'day' end as sp from customer""")


def _tenures(i: Inputs):
    key = F.col("c_custkey")
    term = lambda v: F.struct(v.alias("value"))
    opt = lambda v: F.when(v.isNotNull(), term(v))
    start = F.when(key % 7 != 0, F.lit("2020-01-01T00:00:00Z"))
    precision = F.when((key % 7 != 0) & (key % 11 != 0), F.lit("9")).when(key % 13 == 0, F.lit("day"))
    place = F.when(key % 17 == 0, F.lit("http://example.org/")).otherwise("http://www.wikidata.org/entity/")
    binding = F.struct(
        term(F.concat(F.lit("http://www.wikidata.org/entity/statement/"), key.cast("string"))).alias("statement"),
        term(F.concat(place, F.lit("Q"), (key + 1).cast("string"))).alias("coach"), opt(F.when(key % 2 == 0, F.col("c_name"))).alias("coachLabel"),
        opt(start).alias("start"), opt(precision).alias("startPrecision"),
    )
    doc = F.to_json(F.struct(F.struct(F.array(binding).alias("bindings")).alias("results")))
    return R.parse_tenures(i.table("customer").select(F.concat(F.lit("Q"), (F.col("c_nationkey") + 1).cast("string")).alias("team_entity"), doc.alias("document")))


BAD_TENURE = "case when c_custkey % 17 = 0 then 'coach binding is not an item' when sp = 'day' then 'invalid precision value' when (st is null) <> (sp is null) then 'tenure date lacks its precision' end"


@query("a13_read_tenures", f"""select 'Q' || (c_nationkey + 1) as team_entity, coach as coach_entity, case when c_custkey % 2 = 0 then c_name else coach end as coach_label,
  'http://www.wikidata.org/entity/statement/' || c_custkey as statement_url, st as start_value, cast(sp as int) as start_precision, cast(null as varchar) as end_value,
  cast(null as int) as end_precision, cast(null as varchar) as reference_url from cust join customer using (c_custkey) where {BAD_TENURE} is null""")
def _(i: Inputs):
    return _tenures(i)[0]


@query("a13_rejected_tenures", f"select 'Q' || (c_nationkey + 1) as team_entity, 0 as position, {BAD_TENURE} as reason from cust join customer using (c_custkey) where {BAD_TENURE} is not null")
def _(i: Inputs):
    return _tenures(i)[1]


# --- B: normalization ---------------------------------------------------------------------

@query("b1_action_type", "select provider_type, case when provider_type = 'Mystery' then null else action end as action, count(*) as events from (select *, " + ACTION + " as action from typed) group by 1, 2")
def _(i: Inputs):
    e = N.checked_events(documents(i).parsed)
    return e.groupBy(F.col("e.type.name").alias("provider_type"), F.col("_action").alias("action")).agg(F.count("*").alias("events"))


# Clocks from ``lineitem``: quantity as minutes, tax and discount as seconds out of range at times.
LINE = "cast(l_quantity as int) - 3 as minute, cast(l_discount * 700 as int) as second, l_linenumber - 1 as period"
PROBLEM = "case when period < 1 then 'period must be at least 1' when minute < 0 then 'minute must not be negative' when second not between 0 and 59 then 'second must be in [0, 60)' end"


def _clock_rows(i: Inputs):
    return i.table("lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") - 3).alias("minute"),
        F.round(F.col("l_discount") * 700).cast("int").alias("second"), (F.col("l_linenumber") - 1).alias("period"),
    )


@query("b2_match_clock", f"select l_orderkey, l_linenumber, {PROBLEM} as problem, minute * 60 + second as elapsed_seconds from (select l_orderkey, l_linenumber, {LINE.replace('l_discount * 700', 'round(l_discount * 700)')} from lineitem)")
def _(i: Inputs):
    return _clock_rows(i).select("l_orderkey", "l_linenumber", KC.clock_problem().alias("problem"), KC.elapsed_seconds().alias("elapsed_seconds"))


@query("b3_timestamp_seconds", f"""select event_id, text, case when event_id % 9 = 0 then null else {num('sec0 + frac', 'period_seconds').replace(' as period_seconds', '')} end as period_seconds
  from (select event_id, minute * 60 + second as sec0, case when event_id % 3 = 0 then 0 else (event_id % 1000) / 1000e0 end as frac,
   case when event_id % 9 = 0 then printf('%02d:%02d', minute, second) when event_id % 3 = 0 then printf('00:%02d:%02d', minute, second) else printf('00:%02d:%02d.%03d', minute, second, event_id % 1000) end as text from me)""")
def _(i: Inputs):
    e = F.col("event_id")
    text = (
        F.when(e % 9 == 0, F.format_string("%02d:%02d", "minute", "second"))
        .when(e % 3 == 0, F.format_string("00:%02d:%02d", "minute", "second"))
        .otherwise(F.format_string("00:%02d:%02d.%03d", "minute", "second", e % 1000))
    )
    return i.events.select("event_id", text.alias("text")).withColumn("period_seconds", KC.timestamp_seconds("text"))


OFFSET = "case period when 1 then 0 when 2 then 2700 when 3 then 5400 when 4 then 6300 when 5 then 7200 end"


@query("b4_continuous_clock", f"""select l_orderkey, l_linenumber, case when second < 60 and minute * 60 + second - {OFFSET} >= 0 then minute * 60 + second - {OFFSET} end as period_seconds
  from (select l_orderkey, l_linenumber, cast(l_quantity as int) as minute, cast(round(l_discount * 700) as int) as second, l_linenumber - 1 as period from lineitem)""")
def _(i: Inputs):
    rows = _clock_rows(i).withColumn("clock", F.format_string("%02d:%02d", F.col("minute") + 3, F.col("second")))
    return rows.select("l_orderkey", "l_linenumber", KC.continuous_clock_to_period_seconds("clock", "period").alias("period_seconds"))


@query("b5_normalize_events", f"""select match_id, cast(event_id as varchar) as event_id, sequence, period, minute, second, {num('ts', 'period_seconds')}, team_id, player_id, cast(null as varchar) as position,
  action as event_type, provider_type as provider_event_type, {nums('x', 'y')}, {num("case when provider_type in ('Pass', 'Carry') then end_x end", 'end_x')}, {num("case when provider_type in ('Pass', 'Carry') then end_y end", 'end_y')},
  event_id % 4 = 0 as under_pressure, possession, team_id as possession_team_id from nev""")
def _(i: Inputs):
    return documents(i).events.select(*N.EVENT_COLUMNS)


@query("b6_normalize_passes", """select match_id, cast(event_id as varchar) as event_id, player_id + 1 as recipient_player_id, completed, case when not completed then 'Incomplete' end as pass_outcome, pt as pass_type,
  case when not open_play then pt end as set_piece_type, open_play, 'Ground Pass' as height, event_id % 6 = 0 as is_cross, false as is_shot_assist, false as is_goal_assist from nev where provider_type = 'Pass'""")
def _(i: Inputs):
    return N.passes(documents(i).events)


@query("b7_normalize_carries", "select match_id, cast(event_id as varchar) as event_id from nev where provider_type = 'Carry'")
def _(i: Inputs):
    return N.carries(documents(i).events)


@query("b8_normalize_shots", f"""select match_id, cast(event_id as varchar) as event_id, {num('case when event_id % 17 <> 0 then provider_xg end', 'provider_xg')}, case when scores_goal then 'Goal' else 'Saved' end as shot_outcome,
  scores_goal, st as shot_type, 'Head' as body_part, cast(null as varchar) as key_pass_event_id, {num('end_x', 'shot_end_x')}, {num('end_y', 'shot_end_y')}, {num('case when event_id % 2 = 1 then 1.5 end', 'shot_end_z')} from nev where provider_type = 'Shot'""")
def _(i: Inputs):
    return N.shots(documents(i).events)


@query("b9_normalize_substitutions", f"""select match_id, cast(event_id as varchar) as event_id, team_id, player_id as player_off_id, player_id + 100 as player_on_id, 'Tactical' as reason, period, {num('ts', 'period_seconds')} from nev where provider_type = 'Substitution'""")
def _(i: Inputs):
    return N.substitutions(documents(i).events)


@query("b10_normalize_formations", "select match_id, cast(event_id as varchar) as event_id, team_id, fm as formation, case provider_type when 'Starting XI' then 'starting' else 'tactical_shift' end as kind from nev where provider_type in ('Starting XI', 'Tactical Shift')")
def _(i: Inputs):
    return N.formations(documents(i).events)


part("ngo", """select match_id, cast(event_id as varchar) as event_id, team_id as scoring_team_id, case provider_type when 'Own Goal For' then 'own_goal' else 'shot' end as kind, period = 5 as in_shootout
  from nev where (provider_type = 'Shot' and scores_goal) or provider_type = 'Own Goal For'""")


@query("b11_normalize_goals", "select * from ngo")
def _(i: Inputs):
    return N.goals(documents(i).events)


part("rej", """select match_id, 'unknown event type' as reason, count(*) as records from typed where provider_type = 'Mystery' group by 1
  union all select match_id, 'team is not in the match', count(*) from typed where match_id % 4 = 1 and team_id = 2 group by 1""")
part("rejall", f"""select match_id, 'unknown event type' as reason, count(*) as records from me where {EVERY_TYPE} = 'Mystery' group by 1
  union all select match_id, 'team is not in the match', count(*) from me where match_id % 4 = 1 and team_id = 2 group by 1""")


def _wrong_matches(i: Inputs):
    """Every fourth match is said to be played by another away team."""
    return i.matches.withColumn("away_team_id", F.when(F.col("match_id") % 4 == 1, 3).otherwise(F.col("away_team_id")))


def _rejects(i: Inputs, d: Documents | None = None):
    d, wrong = d or documents(i), _wrong_matches(i)
    return N.adapter_rejects(N.event_rejects(d.parsed, wrong), N.lineup_problems(d.players, wrong))


@query("b12_event_rejects", "select * from rejall")
def _(i: Inputs):
    return N.event_rejects(Documents(i, EVERY_TYPE).parsed, _wrong_matches(i))


part("lrej", """select match_id, 'lineup team does not play the match' as reason from ma where match_id % 4 = 1 union all
  select match_id, 'lineups must list both teams' from ma where match_id % 4 = 1""")
part("arej", "select match_id, string_agg(distinct reason, '; ' order by reason) as reasons from (select match_id, reason from rej union all select * from lrej) group by 1")
part("arejall", "select match_id, string_agg(distinct reason, '; ' order by reason) as reasons from (select match_id, reason from rejall union all select * from lrej) group by 1")


@query("b12_adapter_rejects", "select * from arejall")
def _(i: Inputs):
    return _rejects(i, Documents(i, EVERY_TYPE))


@query("b13_appearances", """select match_id, team_id, case team_id when 1 then 'Rovers' else 'City' end as team_name, player_id, 'Player ' || player_id as player_name, cast(null as varchar) as player_nickname,
  cast(player_id % 30 as int) as jersey_number, player_id <= 12 as started from pl""")
def _(i: Inputs):
    return N.appearances(documents(i).players)


@query("b14_position_spells", f"""select match_id, team_id, player_id, spell_number, 'Wing' as position, start_period, {nums('start_seconds')}, end_period, {nums('end_seconds')},
  case when player_id <= 12 and spell_number = 1 then 'Starting XI' else 'Tactical Shift' end as start_reason, 'Final Whistle' as end_reason, false as invalid from spells""")
def _(i: Inputs):
    return N.position_spells(documents(i).players)


@query("b15_match_records", """select match_id, competition_id, season_id, 'Cup ' || competition_id as competition_name, 'Year ' || season_id as season_name, cast(o_orderdate as date) as match_date,
  case when k % 29 = 0 then '20:00:00Z' else '20:00:00.000' end as kickoff, cast(o_custkey as int) as home_team_id, 'Team ' || o_custkey as home_team_name, cast(o_custkey + 1 as int) as away_team_id,
  'Team ' || (o_custkey + 1) as away_team_name, cast(k % 4 as int) as home_score, cast(k % 3 as int) as away_score, cast(k % 38 as int) as match_week, case when k % 3 = 0 then 'Final' end as stage,
  cast(null as varchar) as stadium, case when k % 6 = 0 then '1.1.0' end as data_version, case when k % 7 <> 0 then '2' end as xy_fidelity_version, '2' as shot_fidelity_version,
  case when k % 5 <> 0 then '2024-01-01T00:00:00' end as provider_last_updated, k % 2 = 0 as has_three_sixty, 'Cup ' || competition_id as recorded_competition_name from oidx""")
def _(i: Inputs):
    return N.match_records(documents(i).index)


@query("b16_player_dim", "select c_nationkey as id, min(c_name) as name from customer group by 1")
def _(i: Inputs):
    return N.name_dim(i.table("customer").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name")), "id", "name")


part("spl", "select o_orderkey as match_id, cast(o_orderkey % 5 as int) as competition_id, cast(o_orderkey % 3 as int) as season_id, case when o_orderkey % 10 < 7 then 'development' when o_orderkey % 10 < 8 then 'validation' else 'test' end as bucket from orders")


def _splits(i: Inputs):
    k = F.col("o_orderkey")
    return i.table("orders").select(
        k.alias("match_id"), (k % 5).cast("int").alias("competition_id"), (k % 3).cast("int").alias("season_id"),
        F.when(k % 10 < 7, "development").when(k % 10 < 8, "validation").otherwise("test").alias("bucket"),
    )


@query("b17_competition_seasons", """select competition_id, season_id, count(*) as catalog_matches, count(*) filter (where bucket = 'development') as development_matches,
  count(*) filter (where bucket = 'validation') as validation_matches, count(*) filter (where bucket = 'test') as test_matches, count(*) filter (where match_id % 4 = 0) as ingested_matches from spl group by 1, 2""")
def _(i: Inputs):
    return N.competition_seasons(_splits(i), _splits(i).where("match_id % 4 = 0"))


@query("b18_field_availability", """select 'events' as table_name, c as field, n as filled, case c when 'under_pressure' then 'hindsight' when 'possession' then 'hindsight' when 'end_x' then 'delayed' else 'known_at_event' end as availability
  from (select unnest(['under_pressure', 'possession', 'end_x', 'x', 'team_id']) as c, unnest([count(*), count(possession), count(case when provider_type in ('Pass', 'Carry') then end_x end), count(x), count(team_id)]) as n from nev)""")
def _(i: Inputs):
    names = ["under_pressure", "possession", "end_x", "x", "team_id"]
    filled = documents(i).events.agg(*[F.count(c).alias(c) for c in names])
    stacked = filled.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in names])))
    return N.field_availability(i.spark).where("table_name = 'events'").join(F.broadcast(stacked), "field").select("table_name", "field", "filled", "availability")


# --- C: quality gate ----------------------------------------------------------------------

# The bridge is clean, so the checked copy is disturbed: every match number decides what breaks.
BROKEN = """match_id, event_id, case when match_id % 5 = 1 and sequence = 7 then 6 else sequence end as sequence, period, minute, second,
  period_seconds - case when match_id % 3 = 1 and event_id % 50 = 0 then 12 else 0 end as period_seconds, case when match_id % 6 = 1 and team_id = 2 then 1 else team_id end as team_id,
  player_id + case when match_id % 4 = 3 and event_id % 90 = 0 then 500 else 0 end as player_id, event_type, x + case when match_id % 7 = 0 and event_id % 40 = 0 then 30 else 0 end as x, y, end_x, end_y, scores_goal"""
part("br", f"select {BROKEN} from me")
part("dma", """select *, home_score + case when match_id % 8 = 5 then 1 else 0 end as hs, case when match_id % 2 = 0 then '1.1.0' end as data_version from ma""")
part("ef", """select match_id, count(*) as event_count, count(distinct sequence) as distinct_sequences, min(sequence) as first_sequence, max(sequence) as last_sequence,
  count(distinct team_id) as team_count, bool_or(team_id = 1) as home_seen, bool_or(team_id = 2) as away_seen,
  count(*) filter (where x not between 0 and 120 or y not between 0 and 80 or end_x not between 0 and 120 or end_y not between 0 and 80) as off_pitch from br group by match_id""")
part("bsub", "select match_id, team_id, player_id as off_id, if(match_id % 9 = 4, player_id + 1, player_id - 4) as on_id from pl where player_id % 5 = 0")
part("steps", """select match_id, event_type, period, period_seconds - max(period_seconds) over (partition by match_id, period order by sequence, event_id rows between unbounded preceding and 1 preceding) as step from
  (select match_id, event_id, sequence, period, event_type, period_seconds - case when match_id % 3 = 1 and event_id % 50 = 0 then 12 else 0 end as period_seconds from me)""")
part("c2", """select match_id, 'raw_checksum' as check_name, 'blocking' as severity, count(*) filter (where not ok) = 0 as passed, count(*) filter (where not ok) || ' of ' || count(*) || ' files not verified' as detail
  from (select coalesce(provider_match_id, try_cast(regexp_extract(relative_path, '(\\d+)', 1) as bigint) // 2) as match_id, coalesce(records = 1 and s = sha256 and n = bytes, false) as ok from sto full join rcps using (relative_path)) group by 1""")
part("c3", "select match_id, 'adapter_validation' as check_name, 'blocking' as severity, reasons is null as passed, coalesce(reasons, 'accepted') as detail from ma left join arej using (match_id)")
part("c4", "select match_id, 'teams_present' as check_name, 'blocking' as severity, team_count = 2 and home_seen and away_seen as passed, team_count || ' teams on events; home seen ' || home_seen || ', away seen ' || away_seen as detail from ef")
MINIMUM_EVENTS = 900
part("c5", f"select match_id, 'event_count_plausible' as check_name, 'blocking' as severity, event_count >= {MINIMUM_EVENTS} as passed, event_count || ' events (minimum {MINIMUM_EVENTS})' as detail from ef")
part("c6", """select match_id, 'sequence_contiguous' as check_name, 'blocking' as severity, first_sequence = 1 and last_sequence = event_count and distinct_sequences = event_count as passed,
  'sequence ' || first_sequence || '..' || last_sequence || ' over ' || event_count || ' events (' || distinct_sequences || ' distinct)' as detail from ef""")
part("c7", "select match_id, 'score_reconciles' as check_name, 'blocking' as severity, home_score = hs as passed, 'events ' || home_score || '-' || away_score || ', match index ' || hs || '-' || away_score as detail from dma")
part("c8", """select m.match_id, 'substitutes_in_lineup' as check_name, 'blocking' as severity, coalesce(n, 0) = 0 as passed, coalesce(n, 0) || ' substitution players missing from the team lineup' as detail
  from ma m left join (select s.match_id, count(*) as n from (select match_id, team_id, unnest([off_id, on_id]) as player_id from bsub) s where not exists (select 1 from pl p where p.match_id = s.match_id and p.team_id = s.team_id and p.player_id = s.player_id) group by 1) x using (match_id)""")
part("c9", """select match_id, 'clock_monotonic' as check_name, 'warning' as severity, count(*) filter (where step < 0) = 0 as passed,
  count(*) filter (where step < 0) || ' backward steps; largest ' || cast(-least(min(step), 0) as decimal(8,3)) || ' s' as detail from steps group by match_id""")
part("c10", "select match_id, 'coordinates_on_pitch' as check_name, 'warning' as severity, off_pitch = 0 as passed, off_pitch || ' events with a start or end location outside 120 x 80' as detail from ef")
part("c11", "select match_id, 'provider_metadata_present' as check_name, 'warning' as severity, data_version is not null as passed, 'data ' || coalesce(data_version, 'missing') || ', xy fidelity 2, shot fidelity 2' as detail from dma")
part("c12", """select m.match_id, 'event_players_in_lineup' as check_name, 'warning' as severity, coalesce(n, 0) = 0 as passed, coalesce(n, 0) || ' event players missing from their team lineup' as detail
  from ma m left join (select match_id, count(distinct player_id) as n from br b where not exists (select 1 from pl p where p.match_id = b.match_id and p.team_id = b.team_id and p.player_id = b.player_id) group by 1) x using (match_id)""")
part("c13", """select m.match_id, 'position_spells_consistent' as check_name, 'warning' as severity, coalesce(n, 0) = 0 as passed, coalesce(n, 0) || ' spells end before they start or overlap a later spell' as detail
  from ma m left join (select match_id, count(*) as n from (select match_id, sk, ek, lead(sk) over (partition by match_id, player_id order by sk, spell_number) as nk from
   (select *, start_period * 10000 + start_seconds as sk, end_period * 10000 + end_seconds as ek from spells)) where ek < sk or ek > nk or (ek is null and nk is not null) group by 1) x using (match_id)""")
part("c14", """select m.match_id, 'substitution_ends_lineup_spell' as check_name, 'warning' as severity, coalesce(n, 0) = 0 as passed,
  coalesce(n, 0) || ' substituted players whose lineup spell runs over a minute past the substitution' as detail
  from ma m left join (select s.match_id, count(distinct off_id) as n from bsub s join spells p on p.match_id = s.match_id and p.player_id = s.off_id
   where coalesce(end_period * 10000 + end_seconds, 1000000000) > 20600 + 60 group by 1) x using (match_id)""")
part("allc", "select * from c2 where match_id in (select match_id from ma) union all " + " union all ".join(f"select * from c{k}" for k in range(3, 15)))
part("dqs", """select match_id, case when bool_or(not passed and severity = 'blocking') then 'excluded' when bool_or(not passed) then 'passed_with_warnings' else 'passed' end as dq_status from allc group by 1""")


class Gate:
    def __init__(self, i: Inputs):
        self.i, self.d = i, documents(i)
        self.events = i.events.selectExpr(*_columns(BROKEN))
        self.matches = i.matches.withColumns(
            {
                "home_score": F.col("home_score") + F.when(F.col("match_id") % 8 == 5, 1).otherwise(0),
                "data_version": F.when(F.col("match_id") % 2 == 0, "1.1.0"),
                "xy_fidelity_version": F.lit("2"),
                "shot_fidelity_version": F.lit("2"),
            }
        )
        self.clean = i.events
        self.back = i.events.withColumn(
            "period_seconds", F.expr("period_seconds - case when match_id % 3 = 1 and event_id % 50 = 0 then 12 else 0 end")
        )

    @cached_property
    def facts(self):
        return Q.event_facts(self.events, self.matches)

    def checks(self) -> dict[str, DataFrame]:
        i, m = self.i, self.matches
        facts = Q.facts_checks(m, self.facts, MINIMUM_EVENTS)
        named = {f"c{n}": facts.where(F.col("check_name") == name) for n, name in ((4, "teams_present"), (5, "event_count_plausible"), (6, "sequence_contiguous"), (10, "coordinates_on_pitch"))}
        return {
            **named,
            "c2": Q.checksum_check(_files(i)).join(m.select("match_id"), "match_id", "left_semi"),
            "c3": Q.adapter_check(m, _rejects(i)),
            "c7": Q.score_check(self.clean, m),
            "c8": Q.substitutes_check(m, i.substitutions, i.appearances),
            "c9": Q.clock_check(m, self.back),
            "c11": Q.metadata_check(m),
            "c12": Q.event_players_check(m, self.events, i.appearances),
            "c13": Q.spells_check(m, i.spells),
            "c14": Q.late_spells_check(m, i.spells, i.substitutions),
        }

    def every(self) -> DataFrame:
        """All thirteen checks of each match, a layer that statuses, report and builds read."""

        def build() -> DataFrame:
            found = self.checks()
            out = Q.facts_checks(self.matches, self.facts, MINIMUM_EVENTS)
            for name in ("c2", "c3", "c7", "c8", "c9", "c11", "c12", "c13", "c14"):
                out = out.unionByName(found[name])
            return out

        return landed(self.i.spark, self.i.folder, "checks", build)


def _columns(text: str) -> list[str]:
    """Split a select list at commas outside parentheses."""
    out, depth, start = [], 0, 0
    for at, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:at])
            start = at + 1
    return [*out, text[start:]]


@query("c1_event_facts", "select match_id, cast(event_count as bigint) as event_count, distinct_sequences, first_sequence, last_sequence, cast(off_pitch as bigint) as off_pitch, team_count, home_seen, away_seen from ef")
def _(i: Inputs):
    return Gate(i).facts


def _files(i: Inputs) -> DataFrame:
    """Outcome of each file with the match that its receipt or its name tells."""
    d = documents(i)
    matches = d.receipts.groupBy("relative_path").agg(F.min("provider_match_id").alias("provider_match_id"))
    files = R.verify_contents(d.stored, d.receipts).join(matches, "relative_path", "left")
    return files.withColumn("match_id", F.coalesce("provider_match_id", F.expr("cast(regexp_extract(relative_path, '([0-9]+)', 1) as bigint) div 2")))


@query("c2_raw_checksum", "select * from c2")
def _(i: Inputs):
    return Q.checksum_check(_files(i))


for _key, _name in (
    ("c3", "adapter_validation"), ("c4", "teams_present"), ("c5", "event_count_plausible"), ("c6", "sequence_contiguous"),
    ("c7", "score_reconciles"), ("c8", "substitutes_in_lineup"), ("c9", "clock_monotonic"), ("c10", "coordinates_on_pitch"),
    ("c11", "provider_metadata_present"), ("c12", "event_players_in_lineup"), ("c13", "position_spells_consistent"),
    ("c14", "substitution_ends_lineup_spell"),
):
    query(f"{_key}_{_name}", f"select * from {_key}")(lambda i, key=_key: Gate(i).checks()[key])


@query("c15_dq_status", "select * from dqs")
def _(i: Inputs):
    return Q.dq_status(Gate(i).every())


part("acc", "select match_id from dqs where dq_status <> 'excluded'")


@query("c15_gated_events", "select match_id, count(*) as events from me where match_id in (select match_id from acc) group by 1")
def _(i: Inputs):
    return Q.gate(i.events, Q.dq_status(Gate(i).every())).groupBy("match_id").agg(F.count("*").alias("events"))


@query("c16_quality_report", """select 1 as section, dq_status as key, dq_status || ': ' || count(*) as line from dqs group by dq_status
  union all select 2, severity || ' ' || check_name, '| ' || check_name || ' | ' || severity || ' | ' || count(*) filter (where passed) || ' | ' || count(*) filter (where not passed) || ' |' from allc group by check_name, severity
  union all select 3, severity || ' ' || check_name || ' ' || match_id, '- ' || match_id || ' `' || check_name || '` (' || severity || '): ' || detail from allc where not passed""")
def _(i: Inputs):
    return Q.quality_report(Gate(i).every())


@query("c17_clock_regression_profile", f"select event_type, period, count(*) as steps, {num('-max(step)', 'smallest')}, {num('-min(step)', 'largest')}, -min(step) > 5 as exceeds_limit from steps where step < 0 group by 1, 2")
def _(i: Inputs):
    return Q.clock_regression_profile(Gate(i).back)


@query("c18_period_offset_check", """select period, min(m) as first_minute, max(m) as last_minute, min(m) = max(m) as passed from
  (select match_id, period, case when period = 2 then 45 + case when match_id % 9 = 1 then 1 else 0 end else 0 end as m from me group by 1, 2) group by 1""")
def _(i: Inputs):
    starts = i.events.groupBy("match_id", "period").agg(F.count("*").alias("n")).select(
        "match_id", "period", F.lit("period_start").alias("event_type"),
        F.when(F.col("period") == 2, 45 + F.when(F.col("match_id") % 9 == 1, 1).otherwise(0)).otherwise(0).alias("minute"),
    )
    return Q.period_offset_check(starts)


@query("c19_attack_direction_check", f"""select match_id, team_id, period, count(*) filter (where event_type = 'shot') as shots, {num("avg(x) filter (where event_type = 'shot')", 'mean_x')},
  coalesce(avg(x) filter (where event_type = 'shot') > 60, false) as passed from me group by 1, 2, 3""")
def _(i: Inputs):
    return Q.attack_direction_check(i.events, 60)


@query("c20_side_orientation_check", f"""select match_id, team_id, side, count(*) as events, {num('avg(y)', 'mean_y')}, (side = 'left' and avg(y) < 80e0 / 3) or (side = 'right' and avg(y) > 160e0 / 3) as passed
  from (select *, case when player_id % 3 = 0 then 'left' when player_id % 3 = 1 then 'right' end as side from me where minute < 40) where side is not null group by 1, 2, 3""")
def _(i: Inputs):
    side = F.when(F.col("player_id") % 3 == 0, "left").when(F.col("player_id") % 3 == 1, "right")
    sides = i.players.select("match_id", "player_id", side.alias("side")).where("side is not null").distinct()
    return Q.side_orientation_check(i.events, sides)


@query("c21_outcome_vocabulary_check", "select provider_type as event_type, case when not completed then 'Incomplete' end as outcome, count(*) as events from nev where provider_type in ('Pass') and not completed group by 1, 2 union all select 'Shot', 'Saved', count(*) from nev where provider_type = 'Shot' and not scores_goal")
def _(i: Inputs):
    e = documents(i).events
    outcomes = e.select(F.col("provider_event_type").alias("event_type"), F.coalesce("pass_outcome", "shot_outcome").alias("outcome"))
    allowed = i.spark.createDataFrame([("Pass", "Out"), ("Pass", "Unknown"), ("Shot", "Goal")], "event_type string, outcome string")
    return Q.outcome_vocabulary_check(outcomes, allowed)
