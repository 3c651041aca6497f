"""The warehouse of a session: layers of accepted matches that other queries read, and queries on its contents."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import context as C
from touchline.operators import detect as D
from touchline.operators import grid as G
from touchline.operators import lineage as L
from touchline.operators import presence as P
from touchline.operators import quality as Q
from touchline.operators import score as S
from touchline.operators.warehouse import Layer, Warehouse, match_digests
from touchline.plans.cards import BURST, SHIFT, STREAM
from touchline.plans.inputs import Inputs, source_key
from touchline.plans.raw import Gate as raw_gate
from touchline.plans.registry import part, query
from touchline.session import new_folder

_open: dict[tuple, Warehouse] = {}


class Only(Inputs):
    """Inputs cut down to the matches that are built; what follows from the context reads the published one."""

    def __init__(self, whole: Inputs, only: Callable[[DataFrame], DataFrame], house: Warehouse):
        super().__init__(whole.spark, whole.folder)
        self._whole, self._only, self._house = whole, only, house

    @cached_property
    def events(self) -> DataFrame:
        return self._only(self._whole.events)

    @cached_property
    def matches(self) -> DataFrame:
        return self._only(self._whole.matches)

    @cached_property
    def players(self) -> DataFrame:
        return self._only(self._whole.players)

    @cached_property
    def context(self) -> DataFrame:
        return self._only(self._house.read("event_context").drop("definition_version", "ingest_run_id"))

    @cached_property
    def windows(self) -> DataFrame:
        return G.fixed_windows(self.context, self.events, self.matches)


def _layers(i: Inputs, house: Warehouse) -> dict[str, Layer]:
    def layer(make: Callable[[Only], DataFrame], *order: str) -> Layer:
        return Layer(lambda only: make(Only(i, only, house)), ("match_id", *order))

    return {
        "events": layer(lambda o: o.events, "sequence"),
        "matches": layer(lambda o: o.matches),
        "team_matches": layer(lambda o: S.team_matches(o.matches), "team_id"),
        "periods": layer(lambda o: S.periods(o.events), "period"),
        "score_states": layer(lambda o: S.score_states(o.events, o.matches), "sequence"),
        "event_context": layer(lambda o: C.event_context(o.events, o.matches), "sequence"),
        "final_third_entries": layer(lambda o: C.final_third_entries(o.context), "sequence"),
        "box_entries": layer(lambda o: C.box_entries(o.context), "sequence"),
        "team_time_bins": layer(lambda o: o.bins, "team_id", "period", "time_bin"),
        "fixed_windows": layer(lambda o: o.windows, "team_id", "period", "window_index"),
        "player_intervals": layer(lambda o: o.intervals, "team_id", "player_id"),
        "player_period_spans": layer(lambda o: o.spans, "team_id", "player_id"),
        "player_match_involvement": layer(lambda o: P.player_match_involvement(o.appearances, o.spans, o.context), "team_id", "player_id"),
        "player_time_bins": layer(lambda o: P.player_time_bins(o.spans, o.bins, o.context), "team_id", "player_id", "period", "time_bin"),
        "possessions": layer(lambda o: G.possessions(o.possession_context), "possession"),
        "team_match_summary": layer(lambda o: G.team_match_summary(o.bins, G.possessions(o.possession_context), o.matches), "team_id"),
        "side_shift_cards": layer(lambda o: D.side_shift_cards(o.events, **SHIFT), "sequence"),
        "burst_cards": layer(lambda o: D.burst_cards(o.events, **BURST), "sequence"),
    }


# Layers that read the context.
FROM_CONTEXT = {
    "final_third_entries", "box_entries", "team_time_bins", "fixed_windows", "player_match_involvement", "player_time_bins", "possessions", "team_match_summary",
}


def build(i: Inputs, names: list[str] | None = None, statuses: DataFrame | None = None, digests: DataFrame | None = None, house: Warehouse | None = None) -> Warehouse:
    """The warehouse with ``names`` (none: all) brought up to date; one for each session and input."""
    key = source_key(i.spark, i.folder)
    if house is None:
        house = _open.setdefault(key, Warehouse(i.spark, new_folder(i.spark, "warehouse")))
    layers = _layers(i, house)
    wanted = set(layers if names is None else names)
    if wanted & FROM_CONTEXT:
        wanted.add("event_context")
    first = [n for n in layers if n in wanted and n == "event_context"]
    rest = [n for n in layers if n in wanted and n != "event_context"]
    if statuses is None:
        if wanted <= set(house.manifest()["layers"]):
            return house
        statuses = Q.dq_status(raw_gate(i).every())
    digests = match_digests(i.events) if digests is None else digests
    run = L.run_identifier({"inputs": str(key[2]), "layers": "1"})
    for group in (first, rest):
        if group:
            house.refresh(statuses, digests, {n: layers[n] for n in group}, run)
    return house


def published(i: Inputs, name: str) -> DataFrame:
    """A layer of accepted matches, without the columns of its lineage."""
    return build(i, [name]).read(name).drop("definition_version", "ingest_run_id")


# Rows of each layer for the comparison; all are cut down to accepted matches.
part("bins_on", """select s.match_id from spans s join tb b on b.match_id = s.match_id and b.team_id = s.team_id and b.period = s.period
  and s.start_seconds < b.bin_end_seconds and s.end_seconds > b.bin_start_seconds group by s.match_id, s.team_id, s.player_id, s.period, b.time_bin""")
LAYER_SQL = {
    "events": "me", "matches": "ma", "team_matches": "tm", "periods": "pe", "score_states": "ss", "event_context": "ctxs", "final_third_entries": "ent",
    "box_entries": "box", "team_time_bins": "tb", "fixed_windows": "win", "player_intervals": "iv", "player_period_spans": "spans",
    "player_match_involvement": "pl", "player_time_bins": "bins_on", "possessions": "pos", "team_match_summary": "tm",
    "side_shift_cards": "(select * from stream where kind = 'side_shift')", "burst_cards": "(select * from stream where kind = 'burst')",
}
ACCEPTED = "match_id in (select match_id from acc)"


@query("a11_publish_layers", f"with {STREAM} " + " union all ".join(
    f"select '{n}' as table_name, 1 as definition_version, count(*) as rows, true as identical from {t} where {ACCEPTED}" for n, t in LAYER_SQL.items()), recursive=True)
def _(i: Inputs):
    """Rows of every published layer, and whether its content is that of the frame it was built from."""
    house = build(i)
    accepted = Q.dq_status(raw_gate(i).every()).where("dq_status <> 'excluded'").select("match_id")
    direct = None
    for name, layer in _layers(i, house).items():
        made = layer.build(lambda df: df.join(accepted, "match_id", "left_semi")).withColumn("definition_version", F.lit(layer.version))
        content = F.coalesce(F.sum(L.content_hash(L.shown_values(made.schema.fields))), F.lit(0)).cast("decimal(38,0)").cast("string")
        row = made.agg(content.alias("again")).withColumn("table_name", F.lit(name))
        direct = row if direct is None else direct.unionByName(row)
    return house.contents().join(direct, "table_name").select("table_name", "definition_version", "rows", (F.col("content") == F.col("again")).alias("identical"))


KEPT = ("event_context", "team_time_bins", "player_intervals")


@query("c15_rebuild_changed_matches", """with a as (select min(match_id) as least, count(*) as n from acc) """ + " union all ".join(
    f"select '{n}' as table_name, (select n from a) as built_first, least(2, (select n from a)) as turned, 0 as turned_again, "
    f"(select count(*) from {LAYER_SQL[n]} where {ACCEPTED} and match_id <> (select least from a)) as rows, true as old_version_stays" for n in KEPT))
def _(i: Inputs):
    """Layers after one match was excluded and another one's content changed: only those two are turned, and the version before still reads."""
    house = Warehouse(i.spark, new_folder(i.spark, "warehouse"))
    statuses, digests = Q.dq_status(raw_gate(i).every()), match_digests(i.events)
    names = list(KEPT)
    accepted = statuses.where("dq_status <> 'excluded'")
    ends = accepted.agg(F.min("match_id").alias("_least"), F.max("match_id").alias("_most"))
    later = statuses.join(F.broadcast(ends)).select("match_id", F.when(F.col("match_id") == F.col("_least"), "excluded").otherwise(F.col("dq_status")).alias("dq_status"))
    changed = digests.join(F.broadcast(ends)).select("match_id", F.when(F.col("match_id") == F.col("_most"), F.concat("digest", F.lit("+"))).otherwise(F.col("digest")).alias("digest"))
    layers = _layers(i, house)
    first: dict[str, int] = {}
    turned: dict[str, int] = {}
    again: dict[str, int] = {}
    for done, status, content in ((first, statuses, digests), (turned, later, changed), (again, later, changed)):
        for group in (names[:1], names[1:]):
            done |= house.refresh(status, content, {n: layers[n] for n in group}, "run")
    out = None
    for name in names:
        before = house.read(name, version=2).join(accepted, "match_id", "left_semi").agg(F.count("*").alias("b"))
        row = house.read(name).agg(F.count("*").alias("rows")).join(F.broadcast(before)).select(
            F.lit(name).alias("table_name"), F.lit(first[name]).cast("bigint").alias("built_first"), F.lit(turned[name]).cast("bigint").alias("turned"),
            F.lit(again[name]).alias("turned_again"), "rows", (F.col("b") >= F.col("rows")).alias("old_version_stays"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("k11_definitions", " union all ".join(f"select '{n}' as table_name, 1 as definition_version, count(*) as rows from {LAYER_SQL[n]} where {ACCEPTED}" for n in L.DEFINITIONS))
def _(i: Inputs):
    found = build(i, list(L.DEFINITIONS)).contents().select("table_name", "rows")
    return L.definitions(i.spark).join(found, "table_name").select("table_name", "definition_version", "rows")
