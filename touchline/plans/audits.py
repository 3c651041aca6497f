"""Queries for card audits, variants, sweeps and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import audit as A
from touchline.operators import cards as K
from touchline.operators import detect as D
from touchline.plans import cards as PC
from touchline.plans.derived import CHANNEL
from touchline.plans.inputs import Inputs, landed
from touchline.plans.raw import documents
from touchline.plans.registry import num, nums, part, query


def _current(i: Inputs):
    """Cards of the every-event rule, with their trigger team."""
    cards = landed(i.spark, i.folder, "variant_cards", lambda: PC._variants(i))
    return cards.where("variant = 'current'").drop("variant")


def _variant(i: Inputs, name: str):
    cards = landed(i.spark, i.folder, "variant_cards", lambda: PC._variants(i))
    return cards.where(F.col("variant") == name)


def _moments(i: Inputs):
    return landed(i.spark, i.folder, "chance_cards", lambda: PC._chances(i))


CUR = f"{PC.VAR_CARDS}, cur as (select * exclude (variant) from vcards where variant = 'current')"
EV = f"select t.match_id, t.team_id, t.sequence as card_sequence, f.event_id, f.ch, f.sequence, case when {PC.REC} then 'recent' else 'baseline' end as role from cur t join entm f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence"
NAMED = PC.PR
MOST = "greatest(recent_left, recent_center, recent_right)"
AUDIT = f"""aud as (select match_id, team_id, sequence as card_sequence, channel,
   r = (select count(*) from ev e where e.match_id = c.match_id and e.team_id = c.team_id and e.card_sequence = c.sequence and role = 'recent')
   and b = (select count(*) from ev e where e.match_id = c.match_id and e.team_id = c.team_id and e.card_sequence = c.sequence and role = 'baseline') as sound,
   actor_id <> team_id as other_team_trigger, r <= 10 as at_most_ten_recent, {NAMED} < {MOST} as not_plurality,
   row_number() over (partition by match_id, team_id, channel order by sequence) > 1 as repeats_channel from cur c)"""


def _audit(i: Inputs):
    entries = A.entries_of(i.events).withColumnRenamed("channel", "entry_channel").withColumn("evidence_team_id", F.col("team_id"))
    return A.card_audit(_current(i), K.evidence(_current(i), entries))


@query("j11_card_audit", f"with {CUR}, ev as ({EV}), {AUDIT} select * from aud", recursive=True)
def _(i: Inputs):
    return _audit(i)


@query("j11_card_audit_summary", f"""with {CUR}, ev as ({EV}), {AUDIT} select channel, count(*) as cards, count(*) filter (where sound) as sound, count(*) filter (where other_team_trigger) as other_team_trigger,
  count(*) filter (where at_most_ten_recent) as at_most_ten_recent, count(*) filter (where not_plurality) as not_plurality, count(*) filter (where repeats_channel) as repeats_channel from aud group by 1""", recursive=True)
def _(i: Inputs):
    return A.card_audit_summary(_audit(i))


@query("j12_card_persistence", f"""with {CUR}, lat as (select c.*, (select count(*) from entm f where f.match_id = c.match_id and f.team_id = c.team_id and f.period = c.period and f.sequence > c.sequence
    and f.elapsed_seconds > c.elapsed_seconds and f.elapsed_seconds <= c.elapsed_seconds + 600) as later,
   (select count(*) from entm f where f.match_id = c.match_id and f.team_id = c.team_id and f.period = c.period and f.sequence > c.sequence
    and f.elapsed_seconds > c.elapsed_seconds and f.elapsed_seconds <= c.elapsed_seconds + 600 and f.ch = c.channel) as later_named from cur c)
  select match_id, team_id, sequence as card_sequence, channel, later, later_named, later >= 8 as eligible, case when later >= 8 then 4 * (later_named * b - {PC.PB} * later) >= later * b end as sustained,
   case when later >= 8 then later_named * r >= {PC.PR} * later end as at_least_recent from lat""", recursive=True)
def _(i: Inputs):
    return A.card_persistence(_current(i), A.entries_of(i.events))


RAW_ENTRY = f"""select match_id, team_id, sequence, period, elapsed_seconds, {CHANNEL.format('end_y')} as ch from nev where provider_type in ('Pass','Carry')
  and (provider_type = 'Carry' or (completed and open_play)) and x < 80 and end_x >= 80"""


@query("j13_independent_recompute", f"""with {PC.SHIFT_CARDS}, raw as ({RAW_ENTRY}) select t.match_id, t.team_id, t.sequence as card_sequence, t.channel,
  {' and '.join(f"{p}_{c} = count(f.sequence) filter (where f.ch = '{c}' and {'' if p == 'recent' else 'not '}({PC.REC}))" for p in ('recent', 'baseline') for c in D.CHANNELS)} as agrees
  from shifts t left join raw f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence
  group by t.match_id, t.team_id, t.sequence, t.channel, {', '.join('t.' + c for c in PC.RB)}""", recursive=True)
def _(i: Inputs):
    return A.independent_recompute(PC._shifts(i), A.entries_of(documents(i).events))


@query("j14_trigger_mechanisms", f"""with {CUR}, pv as (select match_id, sequence, lag(period) over w as pp, lag(elapsed_seconds) over w as pe from me window w as (partition by match_id order by sequence)),
  mech2 as (select *, lag(period) over w as lp, lag(elapsed_seconds) over w as le0 from (select * exclude (lp, le) from cur) window w as (partition by match_id, team_id order by sequence)),
  mech3 as (select mech2.*, pp, pe, ps from mech2 join pv using (match_id, sequence) join pst using (match_id, period) where actor_id <> team_id)
  select match_id, team_id, sequence as card_sequence, channel,
   coalesce(pp = period, false) and exists (select 1 from entm f where f.match_id = c.match_id and f.team_id = c.team_id and f.period = c.period and f.sequence < c.sequence and f.elapsed_seconds > pe - 600 and f.elapsed_seconds <= c.elapsed_seconds - 600) as entry_expired,
   coalesce(pp = period and lp = period and pe < le0 + 600 and elapsed_seconds >= le0 + 600, false) as cooldown_ended, coalesce(pp = period and pe - ps < 600 and elapsed_seconds - ps >= 600, false) as first_full_window,
   case when age is null then 'no_current_period_entry' when age < 0 then 'clock_reversed' when age <= 30 then 'up_to_30_seconds' when age <= 60 then '31_to_60_seconds' when age <= 180 then '61_to_180_seconds' else 'over_180_seconds' end as gap from mech3 c""", recursive=True)
def _(i: Inputs):
    return A.trigger_mechanisms(_current(i), i.events, A.entries_of(i.events))


PAIRED = f"""{PC.VAR_CARDS}, opt as (select a.match_id, a.team_id, a.channel, a.period, a.sequence as a, b.sequence as b, b.elapsed_seconds - a.elapsed_seconds as delay,
    abs(b.elapsed_seconds - a.elapsed_seconds) * 10000000000 + a.sequence * 100000 + b.sequence as k from vcards a join vcards b using (match_id, team_id, channel, period)
    where a.variant = 'current' and b.variant = 'own_entry' and abs(b.elapsed_seconds - a.elapsed_seconds) <= 600),
  taken(match_id, team_id, channel, period, ua, ub, a, b, delay) as (
   select match_id, team_id, channel, period, [arg_min(a, k)], [arg_min(b, k)], arg_min(a, k), arg_min(b, k), arg_min(delay, k) from opt group by 1, 2, 3, 4
   union all select o.match_id, o.team_id, o.channel, o.period, list_append(any_value(ua), arg_min(o.a, k)), list_append(any_value(ub), arg_min(o.b, k)), arg_min(o.a, k), arg_min(o.b, k), arg_min(o.delay, k)
    from taken t join opt o using (match_id, team_id, channel, period) where not list_contains(ua, o.a) and not list_contains(ub, o.b) group by 1, 2, 3, 4),
  paired as (select match_id, team_id, channel, period, 'paired' as state, a as current_sequence, b as variant_sequence, delay from taken
   union all select match_id, team_id, channel, period, 'lost', sequence, null, null from vcards c where variant = 'current' and not exists (select 1 from taken t where t.match_id = c.match_id and t.team_id = c.team_id and t.a = c.sequence)
   union all select match_id, team_id, channel, period, 'new', null, sequence, null from vcards c where variant = 'own_entry' and not exists (select 1 from taken t where t.match_id = c.match_id and t.team_id = c.team_id and t.b = c.sequence))"""


@query("j15_variant_pairing", f"with {PAIRED} select * from paired", recursive=True)
def _(i: Inputs):
    return A.variant_pairing(_current(i), _variant(i, "own_entry"))


@query("j15_pairing_summary", f"""with {PAIRED} select count(*) filter (where state = 'paired') as paired, count(*) filter (where delay = 0) as same_second, count(*) filter (where delay > 0) as later,
  count(*) filter (where delay < 0) as earlier, {num('coalesce(median(delay) filter (where delay > 0), 0)', 'median_delay_of_later')}, count(*) filter (where delay > 120) as later_by_over_120,
  count(*) filter (where state = 'lost') as lost, count(*) filter (where state = 'new') as new from paired""", recursive=True)
def _(i: Inputs):
    return A.pairing_summary(A.variant_pairing(_current(i), _variant(i, "own_entry")))


part("tme", "select m.match_id, m.team_id, count(e.event_id) as entries from tm m left join entm e using (match_id, team_id) group by 1, 2")
part("qed", "select list_sort(list(entries)) as v, count(*) as n from tme")
part("quart", "select t.*, 1 + cast(entries > v[n * 1 // 4 + 1] as int) + cast(entries > v[n * 2 // 4 + 1] as int) + cast(entries > v[n * 3 // 4 + 1] as int) as quartile from tme t, qed")


@query("j16_entry_quartile_coverage", f"""with {CUR}, cc as (select match_id, team_id, count(*) as c from cur group by all) select quartile, count(*) as team_matches, count(*) filter (where c > 0) as with_a_card,
  cast(coalesce(sum(c), 0) as bigint) as cards, max(entries) as upper_entries from quart left join cc using (match_id, team_id) group by 1""", recursive=True)
def _(i: Inputs):
    return A.entry_quartile_coverage(A.entry_quartiles(i.events), _current(i))


GRID_SQL = "(values " + ", ".join(f"('shots>={s},ratio>={n}/{d}', {s}, {n}, {d})" for s, n, d in A.GRID) + ") g(setting, s, n, d)"
part("swp", f"select g.setting, w.* from bw w cross join {GRID_SQL} where earlier_seconds >= 600 and recent_shots >= s and d * recent_shots * earlier_seconds >= n * earlier_shots * 600")


@query("j17_threshold_sweep", f"with {PC.fired('swf', 'swp', 'setting, match_id, team_id, period')} select setting, count(*) as cards, count(distinct match_id * 10 + team_id) as team_matches_with_a_card from swf group by 1", recursive=True)
def _(i: Inputs):
    return A.threshold_sweep(A.threshold_cards(D.burst_windows(i.events)))


part("nsp", """select match_id, period, ps as s, pl_max as e, coalesce(sum(pl_max - ps) over (partition by match_id order by period rows between unbounded preceding and 1 preceding), 0) as off
  from pst join plast using (match_id, period) where pl_max > ps""")
part("nshot", """select match_id, team_id, ref, event_id, arg_max(period, off) as period, cast(arg_max(s + spot - off, off) as bigint) as elapsed_seconds from
  (select b.match_id, b.team_id, r.ref, b.event_id, cast('0x' || substr(md5('20260928:' || ref || ':' || event_id), 1, 15) as bigint) % (select sum(e - s) from nsp p where p.match_id = b.match_id) as spot
   from (select * from me where event_type = 'shot' and not penalty) b, (select unnest(generate_series(1, 10)) as ref) r) x join nsp using (match_id) where off <= spot group by all""")
part("nseq", """select *, row_number() over (partition by match_id, team_id, ref order by period, elapsed_seconds, event_id) as sequence from nshot""")
part("nbw", """select t.match_id, t.team_id, t.ref, t.period, t.sequence, t.elapsed_seconds, max(p.off) + t.elapsed_seconds - 600 - max(p.s) as earlier_seconds,
  count(*) filter (where f.period = t.period and f.elapsed_seconds > t.elapsed_seconds - 600) as recent_shots, count(*) filter (where not (f.period = t.period and f.elapsed_seconds > t.elapsed_seconds - 600)) as earlier_shots
  from nseq t join nsp p on p.match_id = t.match_id and p.period = t.period join nseq f on f.match_id = t.match_id and f.team_id = t.team_id and f.ref = t.ref and f.sequence <= t.sequence
  where t.elapsed_seconds - p.s >= 600 group by t.match_id, t.team_id, t.ref, t.period, t.sequence, t.elapsed_seconds""")
part("nswp", f"select g.setting, w.* from nbw w cross join {GRID_SQL} where earlier_seconds >= 600 and recent_shots >= s and d * recent_shots * earlier_seconds >= n * earlier_shots * 600")


@query("j18_null_shot_baseline", f"""with {PC.fired('swf', 'swp', 'setting, match_id, team_id, period')}, {PC.fired('nf', 'nswp', 'setting, match_id, team_id, ref, period')}
  select setting, coalesce(c, 0) as real_cards, {num('coalesce(n, 0) / 10e0', 'reference_cards')} from (select setting, count(*) as c from swf group by 1) full join (select setting, count(*) as n from nf group by 1) using (setting)""", recursive=True)
def _(i: Inputs):
    return A.null_shot_baseline(i.events)


@query("j19_stream_density", f"""with {PC.STREAM}, nr as (select *, coalesce(elapsed_seconds - lag(elapsed_seconds) over (partition by match_id, period order by elapsed_seconds, kind_rank, team_id) <= 60, false) as near from stream),
  pm as (select match_id, count(*) as cards, count(*) filter (where near) as near, count(distinct team_id) as teams from nr group by 1)
  select coalesce(cards, 0) as cards, coalesce(teams, 0) as teams_with_a_card, count(*) as matches, cast(sum(coalesce(near, 0)) as bigint) as close_pairs from ma left join pm using (match_id) group by 1, 2""", recursive=True)
def _(i: Inputs):
    return A.stream_density(PC._stream(i), i.matches)


@query("j19_bursts_with_a_goal", f"""with {PC.BURST_CARDS}, pc as (select t.match_id, t.team_id, t.sequence, count(*) as n, bool_or(f.scores_goal) as goal from bursts t join (select * from me where event_type = 'shot' and not penalty) f
  on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence and {PC.REC} group by 1, 2, 3) select n as recent_shots, count(*) as cards, count(*) filter (where goal) as with_a_goal from pc group by 1""", recursive=True)
def _(i: Inputs):
    return A.bursts_with_a_goal(PC._bursts(i), i.events)


part("cqr", f"select {PC.CQ} from cq")


@query("j20_candidate_summary", f"""select {num('margin', 'margin')}, count(*) as candidates, count(*) filter (where goals_for < goals_against) as trailing, count(*) filter (where goals_for = goals_against) as level,
  {num('median(minute)', 'median_minute')}, count(*) filter (where minute < 30) as before_minute_30, count(*) filter (where shots_for <= shots_against) as not_more_shots,
  count(*) filter (where 4 * shots_for <= 5 * shots_against) as shots_within_25_percent, count(*) filter (where shots_against = 0 or xg_for * shots_against >= 1.5e0 * xg_against * shots_for) as much_better_per_shot,
  count(*) filter (where period = 1) as first_half, count(*) filter (where largest_shot_share > 0.5e0) as one_shot_over_half, count(*) filter (where gap_with_penalties >= 1e0) as still_at_margin_with_penalties,
  count(distinct match_id) as matches_with_a_candidate, (select max(c) from (select count(*) as c from cqr q where q.margin = cqr.margin group by match_id)) as most_in_a_match, (select count(*) from ma) as matches from cqr group by margin""")
def _(i: Inputs):
    return A.candidate_summary(_moments(i), i.matches)


part("cat", """select *, case when goals_for < goals_against and opponent_finishing >= 1e0 then 'D' when largest_shot_share > 0.5e0 then 'C' when shots_against > 0 and 5 * shots_for >= 4 * shots_against and 4 * shots_for <= 5 * shots_against then 'B'
  when shots_against = 0 or 2 * shots_for >= 3 * shots_against then 'A' end as category from cqr""")


@query("j21_moment_category", f"select {nums('margin')}, match_id, team_id, sequence, category from cat")
def _(i: Inputs):
    return A.moment_category(_moments(i)).select("margin", "match_id", "team_id", "sequence", "category")


def lot(seed: int) -> str:
    return f"cast('0x' || substr(md5('{seed}:' || match_id), 1, 15) as bigint)"


STRATA = [("first cup", "competition_id = 0"), ("second cup", "competition_id = 1"), ("any", "true")]


def strata_sql() -> str:
    steps, used = [], []
    for n, (label, rule) in enumerate(STRATA):
        skip = "".join(f" and match_id not in (select match_id from s{k})" for k in used)
        steps.append(f"s{n} as (select '{label}' as stratum, match_id from ma where {rule} and match_id in (select match_id from shifts){skip} order by {lot(20260928 + n)}, match_id limit 1)")
        used.append(n)
    return ", ".join(steps) + " " + " union all ".join(f"select * from s{n}" for n in used)


@query("j22_stratified_seeded_sample", f"with {PC.SHIFT_CARDS}, {strata_sql()}", recursive=True)
def _(i: Inputs):
    pool = i.matches.join(PC._shifts(i).select("match_id").distinct(), "match_id", "left_semi")
    return A.stratified_sample(pool, [(label, F.expr(rule)) for label, rule in STRATA])


def category_sql() -> str:
    steps, done = [], []
    for n, label in enumerate(("D", "C", "B", "A")):
        skip = "".join(f" and match_id not in (select match_id from k{d})" for d in done)
        for step, margin in enumerate((1.0, 0.75)):
            more = f" and match_id not in (select match_id from t{n}0)" if step else ""
            steps.append(f"""t{n}{step} as (select '{label}' as category, {margin}e0 as margin, match_id, cast(min(sequence * 10 + team_id) // 10 as int) as sequence, cast(min(sequence * 10 + team_id) % 10 as int) as team_id
              from cat where category = '{label}' and margin = {margin}e0{skip}{more} group by match_id order by {lot(20260928 + 10 * n + step)}, match_id limit 3)""")
        steps.append(f"k{n} as (select * from (select * from t{n}0 union all select * from t{n}1) order by margin desc, {lot(20260928)}, match_id limit 3)")
        done.append(n)
    return ", ".join(steps) + " " + " union all ".join(f"select * from k{n}" for n in done)


@query("j22_category_sample", f"with {category_sql()}")
def _(i: Inputs):
    return A.category_sample(A.moment_category(_moments(i).withColumn("margin", F.col("margin").cast("double"))))
