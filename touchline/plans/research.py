"""Queries for research statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import grid as G
from touchline.operators import score as S
from touchline.operators import stats as T
from touchline.plans.inputs import Inputs
from touchline.plans.registry import num, nums, part, query

REPS = 200
SEED = 20260928


def rank2(x: str, by: str = "") -> str:
    p = f"partition by {by}" if by else ""
    q = f"partition by {by}, {x}" if by else f"partition by {x}"
    return f"cast(2 * rank() over ({p} order by {x}) + count(*) over ({q}) - 1 as bigint)"


CORR = """case when n >= 3 then (n * sxy - sx * sy) / nullif(sqrt(greatest(n * sxx - sx * sx, 0)) * sqrt(greatest(n * syy - sy * sy, 0)), 0) end"""
SUMS = "cast(sum({w}) as double) as n, cast(sum({w} * a) as double) as sx, cast(sum({w} * b) as double) as sy, cast(sum({w} * a * a) as double) as sxx, cast(sum({w} * b * b) as double) as syy, cast(sum({w} * a * b) as double) as sxy"


def interval_sql(source: str, x: str, y: str, seed: int, by: str = "g") -> str:
    """Bootstrap over matches with the same hashed draws. ``source`` has a column ``g``."""
    return f"""with r0 as (select {by}, match_id, {rank2(x, by)} as a, {rank2(y, by)} as b from {source} where {x} is not null and {y} is not null),
  per as (select {by}, match_id, {SUMS.format(w='1')} from r0 group by all),
  idx as (select *, row_number() over (partition by {by} order by match_id) as i, count(*) over (partition by {by}) as m from per),
  dr as (select {by}, r, cast('0x' || substr(md5('{seed}:' || r || ':' || i), 1, 15) as bigint) % m + 1 as i from idx, (select unnest(generate_series(1, {REPS})) as r)),
  rep as (select d.{by}, r, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(syy) as syy, sum(sxy) as sxy from dr d join idx using ({by}, i) group by all),
  val as (select {by}, list_sort(list(v)) as v from (select {by}, {CORR} as v from rep) where v is not null group by 1),
  tot as (select {by}, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(syy) as syy, sum(sxy) as sxy, count(*) as matches from per group by 1)
  select {by}, {CORR} as spearman, v[cast(floor(len(v) * 0.025) as bigint) + 1] as low, v[cast(floor(len(v) * 0.975) as bigint)] as high, cast(n as bigint) as observations, matches
  from tot left join val using ({by})"""


def quant(x: str, f: float) -> str:
    return f"list_sort(list({x}))[cast(least(count({x}) - 1, floor({f}e0 * count({x}))) as bigint) + 1]"


DESCRIBE = lambda x: ", ".join([num(f"avg({x})", "mean"), *[num(quant(x, f), n) for n, f in T.DECILES.items()]])


@query("j1_average_ranks", f"select match_id, team_id, period, window_index, entries, {num(rank2('entries') + ' / 2e0', 'entries_rank')} from win where complete")
def _(i: Inputs):
    rows = i.windows.where("complete").select("match_id", "team_id", "period", "window_index", "entries")
    return T.average_ranks(rows, "entries")


@query("j2_pearson_spearman", f"""with a as (select corr(entries, shots) as p, count(*) as n from win where complete),
  b as (select {SUMS.format(w='1')} from (select {rank2('entries')} as a, {rank2('shots')} as b from win where complete))
  select a.n as observations, {num('p', 'pearson')}, {num(CORR.replace(' n ', ' b.n ').replace('(n ', '(b.n ').replace('(n *', '(b.n *'), 'spearman')} from a, b""")
def _(i: Inputs):
    rows = i.windows.where("complete")
    return T.pearson(rows, "entries", "shots").join(T.spearman(rows, "entries", "shots"), "observations")


part("pairs0", "select 0 as g, * from pairs where xg_change is not null")


@query("j3_spearman_cluster_interval", f"select {nums('spearman', 'low', 'high')}, observations, matches from ({interval_sql('pairs0', 'entries_change', 'shots_change', SEED)})")
def _(i: Inputs):
    return T.spearman_cluster_interval(i.pairs.where("xg_change is not null"), "entries_change", "shots_change", replicates=REPS)


@query("j4_nearest_quantile", f"select {DESCRIBE('entries')} from win where complete")
def _(i: Inputs):
    return T.describe(i.windows.where("complete").withColumn("entries", F.col("entries").cast("double")), "entries")


def bins_sql(source: str, key: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    join = f"using ({by})" if by else "on true"
    cuts = ", ".join(f"{quant(key, f)} as {n}" for n, f in T.CUTS.items())
    group = f"group by {by}" if by else ""
    return f"""with cuts as (select {g}{cuts} from {source} where {key} is not null {group}),
  bn as (select s.*, cast({key} > cut1 as int) + cast({key} > cut2 as int) + cast({key} > cut3 as int) + cast({key} > cut4 as int) as bin from {source} s join cuts {join} where {key} is not null)
  select {g}bin, {num(f'min({key})', 'lowest')}, {num(f'max({key})', 'highest')}, count(*) as pairs, {num(f'avg({key})', 'mean_change')}, {num('avg(shots_change)', 'mean_shots_change')},
   {num('avg(xg_change)', 'mean_xg_change')}, {num('avg(case when shots_change > 0 then 1 else 0 end)', 'share_shots_up')}, {num('avg(case when shots_change < 0 then 1 else 0 end)', 'share_shots_down')},
   {num('avg(case when shots_after = 0 then 1 else 0 end)', 'share_no_shot_after')}, {num('avg(shots_after)', 'mean_shots_after')}, {num('avg(coalesce(xg_after, 0))', 'mean_xg_after')},
   {num('cast(sum(coalesce(xg_after, 0)) as double) / nullif(sum(entries_after), 0)', 'xg_per_entry_after')}, count(distinct match_id) as matches from bn group by {g}bin"""


@query("j5_value_bins", bins_sql("pairs", "entries_change"))
def _(i: Inputs):
    return T.value_bins(i.pairs, "entries_change")


def links(source: str, x: str, by: str, out: str = "") -> str:
    one = interval_sql(source, x, "shots_change", SEED, by)
    two = interval_sql(source, x, "xg_change", SEED + 1, by)
    return one, two


ONE, TWO = links("pairs0", "entries_change", "g")
COLS = f"{nums('spearman', 'low', 'high')}, observations, matches"


@query("j6_change_associations", f"select 'entries_vs_shots' as association, {COLS} from ({ONE}) union all select 'entries_vs_xg', {COLS} from ({TWO})")
def _(i: Inputs):
    return T.change_associations(i.pairs, replicates=REPS)


GONE, GTWO = links("pairs0", "entries_change", "competition_id")


@query("j6_by_group", f"""with sz as (select competition_id, count(*) as pairs, count(distinct match_id) as group_matches from pairs group by 1 having count(distinct match_id) >= 3)
  select competition_id, sz.pairs, group_matches, a.* exclude (competition_id) from sz join (select competition_id, 'entries_vs_shots' as association, {COLS} from ({GONE})
   union all select competition_id, 'entries_vs_xg', {COLS} from ({GTWO})) a using (competition_id)""")
def _(i: Inputs):
    return T.by_group(i.pairs, "competition_id", 3, replicates=REPS)


def team_corr(y: str, name: str) -> str:
    return f"""select '{name}' as association, round({CORR}, 9) as v from (select team_id, {SUMS.format(w='1')} from
    (select team_id, {rank2('entries_change', 'team_id')} as a, {rank2(y, 'team_id')} as b from pairs where xg_change is not null) group by 1 having count(*) >= 30)"""


@query("j6_per_team", f"""select association, count(*) as teams, {num('avg(case when v > 0 then 1 else 0 end)', 'share_positive')}, {DESCRIBE('v')}
  from ({team_corr('shots_change', 'entries_vs_shots')} union all {team_corr('xg_change', 'entries_vs_xg')}) where v is not null group by 1""")
def _(i: Inputs):
    return T.per_team(i.pairs)


part("tiltp", """select m.minimum, round(p.tilt_change, 9) as tilt, p.* from pairs p cross join (select unnest([1, 3, 5]) as minimum) m
  where xg_change is not null and tilt_denominator_before >= minimum and tilt_denominator_after >= minimum""")
MINIMUMS = (1, 3, 5)


def _tilted(i: Inputs):
    return i.pairs.withColumn("tilt_change", F.round("tilt_change", 9))


TONE, TTWO = links("tiltp", "tilt", "minimum")


@query("j7_tilt_sensitivity", f"""with sz as (select minimum, count(*) as pairs, count(*) / (select cast(count(*) as double) from pairs) as share, {DESCRIBE('tilt')} from tiltp group by 1)
  select minimum, pairs, {num('share', 'share_of_all_pairs')}, {', '.join(['mean', *T.DECILES])}, {num('a.spearman', 'tilt_vs_shots')}, {num('a.low', 'tilt_vs_shots_low')}, {num('a.high', 'tilt_vs_shots_high')},
  {num('b.spearman', 'tilt_vs_xg')}, {num('b.low', 'tilt_vs_xg_low')}, {num('b.high', 'tilt_vs_xg_high')} from sz join ({TONE}) a using (minimum) join ({TTWO}) b using (minimum)""")
def _(i: Inputs):
    return T.tilt_sensitivity(_tilted(i), MINIMUMS, replicates=REPS)


part("tiltb", "select * exclude (tilt_change), round(tilt_change, 9) as tilt_change from pairs where xg_change is not null and tilt_denominator_before >= 1 and tilt_denominator_after >= 1")


@query("j7_tilt_bins", bins_sql("tiltb", "tilt_change"))
def _(i: Inputs):
    usable = "xg_change is not null and tilt_denominator_before >= 1 and tilt_denominator_after >= 1"
    return T.value_bins(_tilted(i).where(usable), "tilt_change")


@query("j8_counterexamples", f"""with c as (select {quant('entries_change', 0.9)} as top_cut, {quant('entries_change', 0.1)} as bottom_cut from pairs)
  select top_cut, bottom_cut, count(*) filter (where entries_change >= top_cut) as top_pairs, count(*) filter (where entries_change >= top_cut and shots_after = 0) as top_no_shot_after,
  count(*) filter (where entries_change >= top_cut and shots_change < 0) as top_fewer_shots_after, count(*) filter (where entries_change <= bottom_cut) as bottom_pairs,
  count(*) filter (where entries_change <= bottom_cut and shots_change > 0) as bottom_more_shots_after from pairs, c group by 1, 2""")
def _(i: Inputs):
    return T.counterexamples(i.pairs)


SHOWN = ["match_id", "team_id", "period", "window_index", "entries_before", "entries_after", "shots_before", "shots_after"]


@query("j8_counterexample_rows", f"""with c as (select {quant('entries_change', 0.9)} as top_cut from pairs) select {', '.join(SHOWN)} from pairs, c
  where entries_change >= top_cut and shots_after <= 8 order by entries_after desc, match_id, team_id, period, window_index limit 6""")
def _(i: Inputs):
    return T.counterexample_rows(i.pairs, most_shots=8).select(*SHOWN)


def cover(key: str) -> str:
    return f"""select * from (select {key} as competition_id, count(*) filter (where complete) as complete_windows, count(*) filter (where not complete) as incomplete_windows,
   count(*) filter (where complete and match_events = 0) as empty_windows, cast(sum(shots) as bigint) as shots, cast(coalesce(sum(shots) filter (where not complete), 0) as bigint) as shots_in_incomplete,
   cast(sum(shots_missing_xg) as bigint) as shots_missing_xg, count(*) filter (where xg is null) as windows_missing_xg from win group by 1)
  left join (select {key} as competition_id, count(*) as pairs, count(*) filter (where goal_free) as pairs_goal_free from pairs group by 1) using (competition_id)"""


@query("j9_coverage", f"{cover('competition_id')} union all {cover('-1')}")
def _(i: Inputs):
    return T.coverage(i.windows, i.pairs)


def spread(name: str, x: str) -> str:
    below = ", ".join(num(f"avg(case when {x} < {m} then 1 else 0 end)", f"share_below_{m}") for m in (1, 5, 10, 20))
    return f"select '{name}' as measure, {DESCRIBE(x)}, {num(f'avg(case when {x} = 0 then 1 else 0 end)', 'share_zero')}, {below} from win where complete"


@query("j9_distributions", " union all ".join([spread("entries", "entries"), spread("shots", "shots"), spread("xg", "coalesce(xg, 0)"), spread("tilt_denominator", "(tilt_passes + opponent_tilt_passes)")]))
def _(i: Inputs):
    return T.distributions(i.windows)


def _comparisons(i: Inputs):
    return T.comparisons(
        G.earlier_window_excess(i.windows), G.attributed_xg(i.context), S.score_state_at_window_start(i.events, i.matches)
    )


part("cmp", """select e.match_id, e.team_id, e.period, e.window_index, entries, e.shots, e.xg, goals_for, goals_against, round(entry_excess, 9) as entry_excess, round(shot_excess, 9) as shot_excess, xg_excess,
  coalesce(a.xg, 0) as attributed_xg, state from exc e left join atx a using (match_id, team_id, period, window_index) join wstate using (match_id, team_id, period, window_index)""")
part("cmpp", "select unnest(list_filter(['overall', state, case when goals_for + goals_against = 0 then 'goal_free' end], lambda p: p is not null)) as part, * from cmp")


@query("j10_excess_bins", f"""with cuts as (select {', '.join(f"{quant('entry_excess', f)} as {n}" for n, f in T.CUTS.items())} from cmp),
  bn as (select c.*, cast(entry_excess > cut1 as int) + cast(entry_excess > cut2 as int) + cast(entry_excess > cut3 as int) + cast(entry_excess > cut4 as int) as bin from cmp c, cuts)
  select bin, {num('min(entry_excess)', 'lowest')}, {num('max(entry_excess)', 'highest')}, count(*) as windows, {num('avg(entry_excess)', 'mean_entry_excess')}, {num('avg(shot_excess)', 'mean_shot_excess')},
  {num('avg(xg_excess)', 'mean_xg_excess')}, {num('avg(case when shots = 0 then 1 else 0 end)', 'no_shot_share')}, {num('cast(sum(xg) as double) / nullif(sum(entries), 0)', 'all_xg_per_entry')},
  {num('cast(sum(attributed_xg) as double) / nullif(sum(entries), 0)', 'attributed_xg_per_entry')}, count(distinct match_id) as matches from bn group by bin""")
def _(i: Inputs):
    return T.excess_bins(_comparisons(i))


@query("j10_excess_associations", f"select part, {COLS} from ({interval_sql('cmpp', 'entry_excess', 'shot_excess', SEED, 'part')})")
def _(i: Inputs):
    return T.excess_associations(_comparisons(i), replicates=REPS)
