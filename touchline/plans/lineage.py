"""Queries for splits, lineage, claims and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.operators import cards as K
from touchline.operators import detect as D
from touchline.operators import export as E
from touchline.operators import lineage as L
from touchline.operators import score as S
from touchline.operators import splits as P
from touchline.plans import cards as PC
from touchline.plans.inputs import Inputs
from touchline.plans.registry import part, query
from touchline.session import cut_lineage, new_folder

# Matches from ``orders``: the order date is the match date, the priority is the season.
part("om", "select o_orderkey as match_id, 1 as competition_id, cast(substr(o_orderpriority, 1, 1) as int) as season_id, cast(o_orderdate as date) as match_date from orders")
part("od", """select *, row_number() over (partition by competition_id, season_id order by match_date) - 1 as i, sum(n) over (partition by competition_id, season_id order by match_date) as c,
  sum(n) over (partition by competition_id, season_id) as total, count(*) over (partition by competition_id, season_id) as dates from (select competition_id, season_id, match_date, count(*) as n from om group by all)""")
part("ocut", """select a.competition_id, a.season_id, arg_min(a.i, abs(100 * a.c - 70 * a.total) + abs(100 * b.c - 85 * b.total) + a.i * 1e-5 + b.i * 1e-9) as f1,
  arg_min(b.i, abs(100 * a.c - 70 * a.total) + abs(100 * b.c - 85 * b.total) + a.i * 1e-5 + b.i * 1e-9) as f2 from od a join od b on a.competition_id = b.competition_id and a.season_id = b.season_id and a.i < b.i and b.i < b.dates - 1 group by 1, 2""")
part("osp", """select m.match_id, m.competition_id, m.season_id, m.match_date, case when i <= f1 then 'development' when i <= f2 then 'validation' else 'test' end as bucket
  from om m join od using (competition_id, season_id, match_date) join ocut using (competition_id, season_id)""")
part("opr", """select o.match_id, o.competition_id, o.season_id, o.match_date, case when d.match_date is not null then 'development' else bucket end as bucket,
  case when match_id % 4001 = 5 then 'already_inspected' when d.match_date is not null and bucket <> 'development' then 'same_date_as_inspected' end as development_exception
  from osp o left join (select distinct competition_id, season_id, match_date from om where match_id % 4001 = 5) d using (competition_id, season_id, match_date)""")


def _matches(i: Inputs):
    return i.table("orders").select(
        F.col("o_orderkey").alias("match_id"), F.lit(1).alias("competition_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("season_id"),
        F.col("o_orderdate").cast("date").alias("match_date"),
    )


def _split(i: Inputs):
    return P.chronological_split(_matches(i))


def _promoted(i: Inputs):
    return P.promote_inspected(_split(i), _matches(i).where("match_id % 4001 = 5"))


ROW = "match_id, competition_id, season_id, match_date, bucket"


@query("k1_chronological_split", f"select {ROW} from osp")
def _(i: Inputs):
    return _split(i)


@query("k2_promote_inspected", f"select {ROW}, development_exception from opr")
def _(i: Inputs):
    return _promoted(i)


@query("k3_review_sample", """select competition_id, season_id, match_id, place from (select *, row_number() over (partition by competition_id, season_id order by
  sha256('20260928:provider:' || competition_id || ':' || season_id || ':' || match_id), match_id) as place from opr where bucket = 'validation' and season_id <= 3) where place <= 6""")
def _(i: Inputs):
    core = _matches(i).where("season_id <= 3").select("competition_id", "season_id").distinct()
    return P.review_sample(_promoted(i), core, seed=20260928)


@query("k4_select_development", "select distinct w.match_id from (select l_orderkey + 2 as match_id from lineitem) w join osp using (match_id) where bucket = 'development'")
def _(i: Inputs):
    wanted = i.table("lineitem").select((F.col("l_orderkey") + 2).alias("match_id"))
    return P.select_development(_split(i), wanted)[0]


@query("k4_refused_matches", "select distinct w.match_id, coalesce(bucket, 'unknown') as reason from (select l_orderkey + 2 as match_id from lineitem) w left join osp using (match_id) where bucket is distinct from 'development'")
def _(i: Inputs):
    wanted = i.table("lineitem").select((F.col("l_orderkey") + 2).alias("match_id"))
    return P.select_development(_split(i), wanted)[1]


# The "frozen" copy differs: every 977th match was filed under test.
FROZEN = "case when match_id % 977 = 0 then 'test' else bucket end"


@query("k5_verify_split", f"""(select match_id, bucket, 'computed' as only_in from osp except all select match_id, {FROZEN}, 'computed' from osp)
  union all (select match_id, {FROZEN} as bucket, 'frozen' as only_in from osp except all select match_id, bucket, 'frozen' from osp)""")
def _(i: Inputs):
    split = _split(i)
    return P.verify_split(split, split.select("match_id", F.expr(FROZEN).alias("bucket")))


@query("k5_frozen_split", f"""select 1 as version, 0 as only_computed, 0 as only_frozen, false as edited union all
  select 2, (select count(*) from osp where bucket <> {FROZEN}), (select count(*) from osp where bucket <> {FROZEN}), true""")
def _(i: Inputs):
    """The split against two stored versions: itself, and one filed otherwise; the second one's files are then written over."""
    root = new_folder(i.spark, "splits")
    archive, split = P.SplitArchive(i.spark, root), _split(i)
    first = archive.freeze(split)
    again = archive.freeze(split)
    second = archive.freeze(split.select("match_id", F.expr(FROZEN).alias("bucket")))
    out = None
    for version in sorted({first, again, second}):
        sides = archive.verify(split, version).groupBy().agg(
            F.count_if(F.col("only_in") == "computed").alias("only_computed"), F.count_if(F.col("only_in") == "frozen").alias("only_frozen")
        )
        row = cut_lineage(sides.select(F.lit(version).alias("version"), "only_computed", "only_frozen"))
        out = row if out is None else out.unionByName(row)
    split.select("match_id", "bucket").write.mode("overwrite").parquet(f"{root}/version-{second:06d}-{archive.versions()[second]}")
    edited = []
    for version in archive.versions():
        try:
            archive.read(version)
        except ValueError:
            edited.append(version)
    return out.withColumn("edited", F.col("version").isin(edited))


HASH = "cast('0x' || substr(md5({0}), 1, 15) as bigint)"


def sized(c: str) -> str:
    """A value with its length before it, NULL as N."""
    return f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), 'N')"


@query("k6_run_id", f"select c_nationkey, count(*) as inputs, substr(sha256(count(*) || ':' || cast(sum({HASH.format(sized('c_custkey') + ' || ' + sized('c_name'))}) as varchar)), 1, 16) as run_id from customer group by 1", bridge=False)
def _(i: Inputs):
    parts = i.table("customer").select("c_nationkey", F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    return L.run_id(parts, ["c_nationkey"])


def finger(name: str, columns: list[str]) -> str:
    row = " || ".join([sized(f"'{','.join(columns)}'"), *map(sized, columns)])
    return f"select '{name}' as table_name, count(*) as rows, substr(sha256(cast(coalesce(sum({HASH.format(row)}), 0) as varchar)), 1, 16) as content from {name}"


FINGERS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "labels": ["doc_id", "quality", "toxic"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"], "conversations": ["conv_id", "turn", "role", "text"],
}


@query("k7_fingerprint", " union all ".join(finger(n, c) for n, c in FINGERS.items()), bridge=False)
def _(i: Inputs):
    return L.fingerprint({n: i.table(n).select(*c) for n, c in FINGERS.items()})


# Rows that plain joining of texts would take for equal: a bar inside a value, and NULL against its written form.
@query("k7_awkward_values", "select unnest(['bars', 'nulls', 'same']) as table_name, unnest([(select count(*) from customer) = 0, (select count(*) from customer) = 0, true]) as identical", bridge=False)
def _(i: Inputs):
    c = i.table("customer")
    name, other = F.col("c_name"), F.col("c_nationkey").cast("string")
    one = {"bars": c.select(F.concat(name, F.lit("|x")).alias("a"), other.alias("b")), "nulls": c.select(F.lit(None).cast("string").alias("a"), "c_custkey"), "same": c}
    two = {"bars": c.select(name.alias("a"), F.concat(F.lit("x|"), other).alias("b")), "nulls": c.select(F.lit("\\N").alias("a"), "c_custkey"), "same": c.repartition(3)}
    return L.compare_fingerprints(L.fingerprint(one), L.fingerprint(two))


@query("k7_compare_builds", "select unnest(['nation', 'labels']) as table_name, unnest([true, (select count(*) from labels where doc_id % 50 = 0) = 0]) as identical", bridge=False)
def _(i: Inputs):
    one = L.fingerprint({"nation": i.table("nation"), "labels": i.table("labels")})
    other = L.fingerprint({"nation": i.table("nation").repartition(4), "labels": i.table("labels").where("doc_id % 50 <> 0")})
    return L.compare_fingerprints(one, other)


@query("k8_leak_check", "select distinct l_orderkey as match_id, bucket from lineitem left join (select * from osp where match_id % 7 <> 0) on match_id = l_orderkey where bucket is distinct from 'development'")
def _(i: Inputs):
    matches = i.table("lineitem").select(F.col("l_orderkey").alias("match_id")).distinct()
    return P.leak_check(matches, _split(i).where("match_id % 7 <> 0"))


# Claims from ``lineitem``; keys repeat and some fields are wrong on purpose.
part("cl", """select cast(l_orderkey as varchar) || '-' || cast(case when l_linenumber = 7 then 6 else l_linenumber end as varchar) as claim_id, 'team-' || l_suppkey as subject,
  case when l_partkey % 97 = 0 then ' ' else 'coach' end as predicate, l_shipdate as published_at, l_shipdate + interval 2 hour as retrieved_at,
  cast(l_shipdate as date) as valid_from, cast(l_shipdate as date) + cast(l_quantity as int) - 2 as valid_until, l_discount * 11 as confidence,
  case when l_partkey % 89 = 0 then 'http' else 'https' end || '://example.org/' || l_partkey as source_url, l_orderkey, l_linenumber from lineitem""")
part("clj", """select *, case when trim(predicate) = '' then 'a required text is empty' when not starts_with(source_url, 'https://') then 'source must be an https address'
   when valid_from >= valid_until then 'validity must not be empty' when confidence > 1 then 'confidence must be between 0 and 1'
   when l_orderkey % 10 = 0 or count(*) over (partition by claim_id) > 1 then 'claim id was already used' end as reason from cl""")


def _claims(i: Inputs):
    line = F.when(F.col("l_linenumber") == 7, 6).otherwise(F.col("l_linenumber"))
    shipped = F.col("l_shipdate").cast("timestamp")
    day = F.col("l_shipdate").cast("date")
    new = i.table("lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), line.cast("string")).alias("claim_id"),
        F.concat(F.lit("team-"), F.col("l_suppkey").cast("string")).alias("subject"),
        F.when(F.col("l_partkey") % 97 == 0, " ").otherwise("coach").alias("predicate"), F.lit("somebody").alias("value"),
        day.alias("valid_from"), F.date_add(day, F.col("l_quantity").cast("int") - 2).alias("valid_until"),
        shipped.alias("published_at"), (shipped + F.expr("interval 2 hours")).alias("retrieved_at"),
        F.concat(F.when(F.col("l_partkey") % 89 == 0, "http").otherwise("https"), F.lit("://example.org/"), F.col("l_partkey").cast("string")).alias("source_url"),
        (F.col("l_discount") * 11).alias("confidence"), F.lit("open").alias("license_class"),
    )
    existing = i.table("orders").where("o_orderkey % 10 = 0").select(
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda n: F.concat_ws("-", F.col("o_orderkey").cast("string"), n.cast("string")))).alias("claim_id")
    )
    return L.append_claims(existing, new, F.col("retrieved_at") + F.expr("interval 1 hour"))


@query("k9_append_claims", "select claim_id, subject from clj where reason is null")
def _(i: Inputs):
    return _claims(i)[0].select("claim_id", "subject")


@query("k9_rejected_claims", "select claim_id, reason from clj where reason is not null")
def _(i: Inputs):
    return _claims(i)[1]


@query("k10_freeze_at_kickoff", """select a.match_id, c.claim_id, a.subject from (select o_orderkey as match_id, 'team-' || o_custkey as subject, o_orderdate as kickoff, cast(o_orderdate as date) as day from orders) a
  join clj c on c.subject = a.subject and reason is null and published_at < kickoff and published_at + interval 3 hour <= kickoff and valid_from <= day and valid_until > day""")
def _(i: Inputs):
    asks = i.table("orders").select(
        F.col("o_orderkey").alias("match_id"), F.concat(F.lit("team-"), F.col("o_custkey").cast("string")).alias("subject"),
        F.col("o_orderdate").cast("timestamp").alias("kickoff_utc"), F.col("o_orderdate").cast("date").alias("local_date"),
    )
    return L.freeze_at_kickoff(_claims(i)[0], asks).select("match_id", "claim_id", "subject")


@query("k12_provenance", "select match_id, 'abc123' as run_source_commit, '1' as run_split_version, count(*) as events from me group by match_id")
def _(i: Inputs):
    found = i.events.groupBy("match_id").agg(F.count("*").alias("events"))
    return L.with_provenance(found, {"source_commit": "abc123", "split_version": "1"})


@query("a11_write_tables", "select 'events' as table_name, count(*) as rows from me union all select 'matches', count(*) from ma union all select 'periods', count(*) from pe")
def _(i: Inputs):
    folder = new_folder(i.spark, "layer")
    L.write_tables(
        {
            "events": (i.events, ["match_id", "sequence"]), "matches": (i.matches, ["match_id"]),
            "periods": (S.periods(i.events), ["match_id", "period"]),
        },
        folder,
    )
    tables = L.read_tables(i.spark, folder, ["events", "matches", "periods"])
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("a12_write_match_export", f"""with {PC.STREAM} select match_id, 'match' as section, 1 as lines from ma union all select match_id, 'period', count(*) from recp group by 1
  union all select match_id, 'goal', count(*) from sa where scores_goal group by 1 union all select match_id, 'card', count(*) from stream group by 1 union all select match_id, 'fact', count(*) from facts group by 1
  union all select t.match_id, 'evidence', count(*) from stream t join me f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence and {PC.REC}
   where (f.event_type = 'shot' and not f.penalty and kind = 'burst') or (f.event_type in ('pass','carry') and f.completed and f.open_play and f.x < 80 and f.end_x >= 80) group by 1""", recursive=True)
def _(i: Inputs):
    stream, facts = PC._stream(i), D.recorded_facts(i.facts)
    boundary = F.when(F.col("event_type") == "pressure", "period_start").when(F.col("event_type") == "ball_recovery", "period_end")
    lines = E.export_lines(
        i.matches, S.recorded_periods(i.events.withColumn("event_type", boundary)), S.goal_timeline(i.events, i.matches), stream,
        K.render_cards(PC._shifts(i), PC._bursts(i), facts, PC._teams(i)), K.stream_evidence(stream, i.events), facts,
    )
    folder = new_folder(i.spark, "export")
    E.write_match_export(lines, i.matches, folder)
    text = i.spark.read.text(f"{folder}/documents")
    has = lambda key: F.get_json_object("value", f"$.{key}").isNotNull()
    section = (
        F.when(has("date"), "match").when(has("start_minute"), "period").when(has("trigger_event_id"), "card").when(has("role"), "evidence")
        .when(has("score"), "goal").otherwise("fact")
    )
    return text.groupBy(F.col("match_id").cast("bigint").alias("match_id"), section.alias("section")).agg(F.count("*").alias("lines"))


def _named_matches(i: Inputs):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return i.matches.withColumns({
        "competition_name": name("Cup ", "competition_id"), "season_name": name("Year ", "season_id"),
        "home_team_name": F.lit("Rovers"), "away_team_name": F.lit('City "Utd"'),
    })


def _chunks(i: Inputs, chunk_bytes: int):
    stream, facts = PC._stream(i), D.recorded_facts(i.facts)
    boundary = F.when(F.col("event_type") == "pressure", "period_start").when(F.col("event_type") == "ball_recovery", "period_end")
    name = lambda lines, kind, cards: lines.join(
        cards.select("match_id", "team_id", F.col("sequence").alias("card_sequence"), F.concat(F.lit(f"{kind}-"), F.col("event_id").cast("string")).alias("card_id")),
        ["match_id", "team_id", "card_sequence"],
    )
    lines = name(K.render_evidence(PC._shifts(i), i.events), "side_shift", PC._shifts(i)).unionByName(name(K.render_burst_evidence(PC._bursts(i), i.events), "burst", PC._bursts(i)))
    pieces = E.document_pieces(
        _named_matches(i), S.recorded_periods(i.events.withColumn("event_type", boundary)), S.goal_timeline(i.events.withColumn("own_goal", F.col("event_id") % 2 == 0), i.matches),
        stream, K.render_cards(PC._shifts(i), PC._bursts(i), facts, PC._teams(i)), K.stream_evidence(stream, i.events), lines, facts, 'Data: "bridge"', "bridge",
    )
    return E.document_chunks(pieces, chunk_bytes)


DOCUMENT = """struct<schema_version: int, attribution: string, match: struct<id: bigint, competition: string, season: string, date: string, home: struct<id: int, name: string>,
  away: struct<id: int, name: string>>, periods: array<struct<period: int, start: struct<minute: int, second: int>, end: struct<minute: int, second: int>>>,
  goals: array<struct<event_id: bigint, team_id: int, own_goal: boolean, penalty: boolean, score: struct<home: bigint, away: bigint>>>,
  cards: array<struct<id: string, kind: string, experimental: boolean, trigger_event_id: bigint, score: struct<home: bigint, away: bigint>, sentence: string,
    evidence_lines: array<string>, evidence: array<struct<event_id: bigint, role: string, action: string>>, sources: array<string>>>,
  facts: array<struct<kind: string, team_id: int, sentence: string, event_id: bigint>>>"""


def _told(array: str, text: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(array, text), "\n")


def _bar(*parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


@query("a12_match_documents", f"""with {PC.STREAM}, lines as (select l.match_id, card_id, string_agg(trim(text), '/' order by section, position) as lines from (
    select *, 'burst' as kind from ({PC.BURST_LINES}) union all select *, 'side_shift' from ({PC.SHIFT_LINES})) l
    join stream s on s.match_id = l.match_id and s.team_id = l.team_id and s.sequence = l.card_sequence and s.kind = l.kind group by all),
  shown as (select t.match_id, card_id, string_agg(role || f.event_id, '/' order by role = 'recent', f.sequence) as shown from stream t
    join (select *, case when event_type = 'shot' then 'shot' else 'recent' end as role from me) f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence and {PC.REC}
    where (f.event_type = 'shot' and not f.penalty and kind = 'burst') or (f.event_type in ('pass','carry') and f.completed and f.open_play and f.x < 80 and f.end_x >= 80) group by all),
  texts as (select match_id, team_id, event_id, 'side_shift' as kind, {PC.SHIFT_TEXT} as sentence from (select *, {PC.LARGER} as lg from shifts) join {PC.TEAMS_SQL} using (team_id)
    union all select match_id, team_id, event_id, 'burst', {PC.BURST_TEXT} from bursts join {PC.TEAMS_SQL} using (team_id)
    union all select match_id, team_id, event_id, kind, {PC.FACT_TEXT} from facts join {PC.TEAMS_SQL} using (team_id))
  select match_id, 1 as schema_version, 'Data: "bridge"' as attribution, 'Cup ' || competition_id || '|Year ' || season_id || '|' || match_date || '|1|Rovers|2|City "Utd"' as match,
    coalesce((select string_agg(period || '|' || s // 60 || ':' || s % 60 || '|' || e // 60 || ':' || e % 60, chr(10) order by period) from recp r where r.match_id = m.match_id), '') as periods,
    coalesce((select string_agg(event_id || '|' || team_id || '|' || (event_id % 2 = 0) || '|' || penalty || '|' || home_score_after || '-' || away_score_after, chr(10) order by sequence)
      from sa g where g.match_id = m.match_id and scores_goal), '') as goals,
    coalesce((select string_agg(card_id || '|' || experimental || '|' || home_score || '-' || away_score || '|' || sentence || '|' || lines || '|' || coalesce(shown, '') || '|bridge', chr(10) order by sequence * 2 + kind_rank)
      from stream c join texts using (match_id, team_id, event_id, kind) join lines using (match_id, card_id) left join shown using (match_id, card_id) where c.match_id = m.match_id), '') as cards,
    coalesce((select string_agg(kind || '|' || team_id || '|' || sentence || '|' || event_id, chr(10) order by f.sequence) from facts f join texts using (match_id, team_id, event_id, kind) where f.match_id = m.match_id), '') as facts
  from ma m""", recursive=True)
def _(i: Inputs):
    """The written documents read back and told again; chunks are small here, so that documents consist of several."""
    folder = new_folder(i.spark, "documents")
    E.write_documents(_chunks(i, 20_000), _named_matches(i), folder)
    files = i.spark.read.text(f"{folder}/documents", wholetext=True).withColumn("_file", F.col("_metadata.file_path"))
    whole = files.groupBy("match_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_file", "value"))), lambda f: f["value"]), "").alias("text"))
    d = whole.select(F.col("match_id").cast("bigint").alias("match_id"), F.from_json("text", DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
    m = F.col("d.match")
    clock = lambda c: F.concat_ws(":", c["minute"], c["second"])
    score = lambda s: F.concat_ws("-", s["home"], s["away"])
    return d.select(
        "match_id", F.col("d.schema_version").alias("schema_version"), F.col("d.attribution").alias("attribution"),
        _bar(m["competition"], m["season"], m["date"], m["home"]["id"], m["home"]["name"], m["away"]["id"], m["away"]["name"]).alias("match"),
        _told("d.periods", lambda p: _bar(p["period"], clock(p["start"]), clock(p["end"]))).alias("periods"),
        _told("d.goals", lambda g: _bar(g["event_id"], g["team_id"], g["own_goal"], g["penalty"], score(g["score"]))).alias("goals"),
        _told("d.cards", lambda c: _bar(
            c["id"], c["experimental"], score(c["score"]), c["sentence"], F.array_join(c["evidence_lines"], "/"),
            F.array_join(F.transform(c["evidence"], lambda e: F.concat(e["role"], e["event_id"].cast("string"))), "/"), F.array_join(c["sources"], "/"),
        )).alias("cards"),
        _told("d.facts", lambda f: _bar(f["kind"], f["team_id"], f["sentence"], f["event_id"])).alias("facts"),
    )
