"""Queries for detectors and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import cards as K
from touchline.operators import detect as D
from touchline.operators import score as S
from touchline.plans.derived import CHANNEL
from touchline.plans.inputs import Inputs, landed
from touchline.plans.registry import num, part, query

# Thresholds low enough for cards to appear on the given tables; the functions keep their own.
SHIFT = dict(minimum_recent=4, minimum_baseline=6)
BURST = dict(minimum_ratio=(3, 2))

part("entm", f"""select *, {CHANNEL.format('end_y')} as ch from me
  where event_type in ('pass','carry') and completed and open_play and x < 80 and end_x >= 80""")
part("pst", "select match_id, period, arg_min(elapsed_seconds, sequence) as ps from me group by match_id, period")
part("plast", "select match_id, period, max(elapsed_seconds) as pl_max, arg_max(elapsed_seconds, sequence) as pl_last, max(sequence) as pl_seq from me group by match_id, period")


part("shots2", "select * from me where event_type = 'shot'")


def counts(prefix: str, test: str) -> str:
    return ", ".join(f"count(*) filter (where f.ch = '{c}' and {test}) as {prefix}_{c}" for c in D.CHANNELS)


REC = "f.period = t.period and f.elapsed_seconds > t.elapsed_seconds - 600"
POS = "match_id, team_id, period, sequence, elapsed_seconds, event_id, minute, second"
TPOS = ", ".join(f"t.{c.strip()}" for c in POS.split(","))
part("trig_own", "select * from entm join pst using (match_id, period) where elapsed_seconds - ps >= 600")
part("trig_all", """select m.* exclude (team_id), m.team_id as actor_id, s.team_id, ps from me m join pst using (match_id, period)
  cross join (select 1 as team_id union all select 2) s where elapsed_seconds - ps >= 600""")
SHIFTW = "select {pos}, {extra} {r}, {b} from {trig} t join entm f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence group by {pos}{grp}"
part("sw_own", SHIFTW.format(pos=TPOS, extra="", r=counts("recent", REC), b=counts("baseline", f"not ({REC})"), trig="trig_own", grp=""))
part("sw_all", SHIFTW.format(pos=TPOS, extra="t.actor_id, arg_max(f.period, f.sequence) as lp, arg_max(f.elapsed_seconds, f.sequence) as le, max(f.sequence) as lseq,",
                             r=counts("recent", REC), b=counts("baseline", f"not ({REC})"), trig="trig_all", grp=", t.actor_id"))


def shift_cand(source: str, recent: int = 4, baseline: int = 6) -> str:
    gain = {c: f"(recent_{c} * b - baseline_{c} * r)" for c in D.CHANNELS}
    return f"""select * from (select *, case when {gain['left']} >= {gain['center']} and {gain['left']} >= {gain['right']} then 'left'
     when {gain['center']} >= {gain['right']} then 'center' else 'right' end as channel,
     greatest({', '.join(gain.values())}) as g from (select *, recent_left + recent_center + recent_right as r,
      baseline_left + baseline_center + baseline_right as b from {source})) where r >= {recent} and b >= {baseline} and 4 * g >= r * b"""


part("sc_own", shift_cand("sw_own"))
part("sc_all", shift_cand("sw_all"))


def fired(name: str, source: str, keys: str = "match_id, team_id, period", seconds: int = 600) -> str:
    """Greedy cooldown as a recursion: each round finds the next card of every key."""
    c = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    n = len(keys.split(","))
    group = ", ".join(str(i + 1) for i in range(n))
    return f"""{name}({keys}, sequence, elapsed_seconds) as (
    select {keys}, min(sequence), arg_min(elapsed_seconds, sequence) from {source} group by {group}
    union all select {c}, min(c.sequence), arg_min(c.elapsed_seconds, c.sequence) from {name} f join {source} c using ({keys})
    where c.sequence > f.sequence and c.elapsed_seconds >= f.elapsed_seconds + {seconds} group by {group})"""


SHIFT_CARDS = f"{fired('sf', 'sc_own')}, shifts as (select c.* from sc_own c join sf using (match_id, team_id, period, sequence))"
RB = [f"{p}_{c}" for p in ("recent", "baseline") for c in D.CHANNELS]
LOSING = "concat_ws(',', " + ", ".join(f"case when recent_{c} * b < baseline_{c} * r then '{c}' end" for c in D.CHANNELS) + ")"


def _shifts(i: Inputs):
    """Card tables are a layer too: what follows from cards reads them."""
    return landed(i.spark, i.folder, "shift_cards", lambda: D.side_shift_cards(i.events, **SHIFT))


def _bursts(i: Inputs):
    return landed(i.spark, i.folder, "burst_cards", lambda: D.burst_cards(i.events, **BURST))


@query("h0_replay_order_guard", "select match_id, case when sequence % 16 = 2 then sequence - 1 else sequence end as sequence, count(*) as events from me group by 1, 2 having count(*) > 1")
def _(i: Inputs):
    # Here every sixteenth event repeats the sequence before it.
    again = F.expr("case when sequence % 16 = 2 then sequence - 1 else sequence end")
    return D.order_violations(i.events.withColumn("sequence", again))


@query("h1_prefix_window", f"""select {TPOS}, count(*) filter (where {REC}) as recent_entries, count(*) filter (where not ({REC})) as earlier_entries
  from trig_own t join entm f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence group by {TPOS}""")
def _(i: Inputs):
    w = D.side_shift_windows(i.events)
    total = lambda p: F.col(f"{p}_left") + F.col(f"{p}_center") + F.col(f"{p}_right")
    return w.select(*[c.strip() for c in POS.split(",")], total("recent").alias("recent_entries"), total("earlier").alias("earlier_entries"))


@query("h2_greedy_cooldown", f"with {fired('fr', 'shots2')} select match_id, team_id, period, sequence, elapsed_seconds from fr", recursive=True)
def _(i: Inputs):
    from touchline.functions.prefix import greedy_cooldown

    shots = i.events.where("event_type = 'shot'").select("match_id", "team_id", "period", "sequence", "elapsed_seconds")
    return greedy_cooldown(shots, 600)




@query("h3_side_shift_candidates", f"select {POS}, channel, {', '.join(RB)} from sc_own")
def _(i: Inputs):
    return D.side_shift_candidates(i.events, **SHIFT)


@query("h4_side_shift_cards", f"with {SHIFT_CARDS} select {POS}, channel, {', '.join(RB)}, r as recent_total, b as baseline_total, {LOSING} as losing_channels, 'bridge' as sources from shifts where match_id in (select match_id from acc)", recursive=True)
def _(i: Inputs):
    from touchline.plans.build import published

    return published(i, "side_shift_cards")


@query("h4_side_shift_evidence", f"""with {SHIFT_CARDS} select t.match_id, t.team_id, t.sequence as card_sequence, f.event_id, f.ch as channel,
  case when {REC} then 'recent' else 'baseline' end as role from shifts t join entm f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence""", recursive=True)
def _(i: Inputs):
    entries = i.events.where(D.is_final_third_entry()).withColumn("channel", D.channel("end_y"))
    return K.evidence(_shifts(i), entries).select("match_id", "team_id", "card_sequence", "event_id", "channel", "role")


part("sc_var", """select v.variant, s.*, case when lp = period then elapsed_seconds - le end as age from sc_all s
  cross join (select unnest(['current','own_entry','own_entry_within_30s','own_entry_within_60s','own_entry_within_120s']) as variant) v
  where case v.variant when 'current' then true when 'own_entry' then lseq = sequence
   when 'own_entry_within_30s' then lp = period and elapsed_seconds - le <= 30 when 'own_entry_within_60s' then lp = period and elapsed_seconds - le <= 60
   else lp = period and elapsed_seconds - le <= 120 end""")
VAR_CARDS = f"{fired('vf', 'sc_var', 'variant, match_id, team_id, period')}, vcards as (select c.* from sc_var c join vf using (variant, match_id, team_id, period, sequence))"


def _variants(i: Inputs):
    return D.side_shift_variants(i.events, **SHIFT)


@query("h5_side_shift_variants", f"with {VAR_CARDS} select variant, {POS}, actor_id, channel, age as seconds_since_own_entry, {', '.join(RB)} from vcards", recursive=True)
def _(i: Inputs):
    return _variants(i)


part("bshot", "select m.*, ps from me m join pst using (match_id, period) where event_type = 'shot' and not penalty")
part("bw", f"""select {TPOS}, 600 as window_seconds,
  (select coalesce(sum(l.pl_max - p.ps), 0) from plast l join pst p using (match_id, period) where l.match_id = t.match_id and l.period < t.period)
    + t.elapsed_seconds - 600 - max(t.ps) as earlier_seconds,
  count(*) filter (where f.event_type = 'shot' and {REC}) as recent_shots, count(*) filter (where f.event_type = 'shot' and not ({REC})) as earlier_shots,
  count(*) filter (where f.event_type <> 'shot' and {REC}) as recent_entries, count(*) filter (where f.event_type <> 'shot' and not ({REC})) as earlier_entries
  from (select * from bshot where elapsed_seconds - ps >= 600) t join (select * from me where (event_type = 'shot' and not penalty)
   or (event_type in ('pass','carry') and completed and open_play and x < 80 and end_x >= 80)) f
  on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence group by {TPOS}""")
part("bc", "select * from bw where earlier_seconds >= 600 and recent_shots >= 4 and 2 * recent_shots * earlier_seconds >= 3 * earlier_shots * 600")
BURST_CARDS = f"{fired('bf', 'bc')}, bursts as (select c.* from bc c join bf using (match_id, team_id, period, sequence))"
BCOLS = "window_seconds, cast(earlier_seconds as bigint) as earlier_seconds, recent_shots, earlier_shots, recent_entries, earlier_entries"


@query("h6_burst_cards", f"with {BURST_CARDS} select {POS}, {BCOLS} from bursts", recursive=True)
def _(i: Inputs):
    return D.burst_cards(i.events, **BURST)


@query("h6_burst_candidates", f"select {POS}, {BCOLS} from bc")
def _(i: Inputs):
    return D.burst_candidates(i.events, **BURST)


@query("h7_earlier_playing_seconds", """select match_id, team_id, period, sequence, elapsed_seconds, event_id, cast((select coalesce(sum(l.pl_max - p.ps), 0) from plast l
  join pst p using (match_id, period) where l.match_id = t.match_id and l.period < t.period) + elapsed_seconds - 600 - ps as bigint) as earlier_seconds from bshot t""")
def _(i: Inputs):
    return D.earlier_playing_seconds(i.events)


part("fac", """select match_id, team_id, sequence, event_id, period, minute, second,
  case event_id % 10 when 0 then 'substitution' when 3 then 'starting' else 'tactical_shift' end as k,
  case when event_id % 10 <> 0 then case event_id % 3 when 0 then '442' when 1 then '433' else '352' end end as formation,
  case when event_id % 10 = 0 then player_id end as player_off_id, case when event_id % 10 = 0 then player_id + 100 end as player_on_id
  from me where event_type = 'ball_recovery' and event_id % 10 in (0, 3, 6)""")
part("fprev", """select *, lag(formation) over w as pf, lag(event_id) over w as pe_id from fac where k <> 'substitution'
  window w as (partition by match_id, team_id order by sequence)""")
part("facts", """select match_id, team_id, sequence, event_id, period, minute, second, case k when 'starting' then 'lineup' else 'formation_change' end as kind,
  formation, case when k = 'tactical_shift' then pf end as previous_formation, case when k = 'tactical_shift' then pe_id end as previous_event_id,
  player_off_id, player_on_id from fprev where k = 'starting' or pf <> formation
  union all select match_id, team_id, sequence, event_id, period, minute, second, 'substitution', null, null, null, player_off_id, player_on_id from fac where k = 'substitution'""")


@query("h8_recorded_facts", "select * from facts")
def _(i: Inputs):
    return D.recorded_facts(i.facts)


STREAM = f"""{SHIFT_CARDS}, {BURST_CARDS}, stream as (select {TPOS}, kind, kind_rank, kind = 'burst' as experimental, home_score_after as home_score, away_score_after as away_score,
  kind || '-' || cast(event_id as varchar) as card_id from (select {POS}, 'burst' as kind, 0 as kind_rank from bursts union all select {POS}, 'side_shift', 1 from shifts) t
  join (select match_id, sequence, home_score_after, away_score_after from sa) using (match_id, sequence))"""


def _stream(i: Inputs):
    return K.card_stream(_shifts(i), _bursts(i), i.events, i.matches)


@query("h9_card_stream", f"with {STREAM} select * from stream", recursive=True)
def _(i: Inputs):
    return K.in_replay_order(_stream(i))


@query("h10_card_evidence_rows", f"""with {STREAM} select t.match_id, card_id, f.event_id, case when f.event_type = 'shot' then 'shot' else 'recent' end as role, f.sequence, f.period, f.minute, f.second,
  f.team_id, f.event_type as action, {num('f.x', 'start_x')}, {num('f.y', 'start_y')}, {num("case when f.event_type <> 'shot' then f.end_x end", 'end_x')}, {num("case when f.event_type <> 'shot' then f.end_y end", 'end_y')}
  from stream t join me f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence and {REC}
  where (f.event_type = 'shot' and not f.penalty and kind = 'burst') or (f.event_type in ('pass','carry') and f.completed and f.open_play and f.x < 80 and f.end_x >= 80)""", recursive=True)
def _(i: Inputs):
    return K.stream_evidence(_stream(i), i.events)


# --- chance quality -----------------------------------------------------------------------

part("cqs", """select s.*, side.team_id as side_id, s.team_id = side.team_id as own from (select * from me where event_type = 'shot' and period < 5) s
  cross join (select 1 as team_id union all select 2) side""")
part("cqm", """select match_id, side_id as team_id, period, sequence, elapsed_seconds, event_id, minute, second,
  sum(case when own and not penalty then provider_xg else 0 end) over w as xf, sum(case when not own and not penalty then provider_xg else 0 end) over w as xa,
  sum(case when own then provider_xg else 0 end) over w as axf, sum(case when not own then provider_xg else 0 end) over w as axa,
  count(*) filter (where own and not penalty) over w as shots_for, count(*) filter (where not own and not penalty) over w as shots_against,
  count(*) filter (where own and scores_goal) over w as goals_for, count(*) filter (where not own and scores_goal) over w as goals_against,
  count(*) filter (where not own and scores_goal and not penalty) over w as oga, max(case when own and not penalty then provider_xg end) over w as big
  from cqs window w as (partition by match_id, side_id order by sequence)""")
part("cq", """select * from (select *, row_number() over (partition by margin, match_id, team_id, goals_for, goals_against order by sequence) as rn
  from cqm cross join (select unnest([0.75, 1.0, 1.25, 1.5]) as margin) where xf - xa >= margin and goals_for <= goals_against) where rn = 1""")
MARGINS = ("0.75", "1.0", "1.25", "1.5")
CQ = f"""{num('margin', 'margin')}, {POS}, goals_for, goals_against, {num('round(xf, 2)', 'xg_for')}, {num('round(xa, 2)', 'xg_against')}, shots_for, shots_against,
  {num('round(cast(big as double) / nullif(cast(xf as double), 0), 9)', 'largest_shot_share')}, {num('axf - axa', 'gap_with_penalties')}, {num('oga - xa', 'opponent_finishing')}"""


def _chances(i: Inputs):
    return D.chance_quality_cards(i.events, MARGINS)


@query("h11_chance_quality_cards", f"select {CQ} from cq where margin = 1.0")
def _(i: Inputs):
    return D.chance_quality_cards(i.events)


# --- prototypes ---------------------------------------------------------------------------

TERRITORY = dict(minimum_recent=5, minimum_baseline=10, minimum_share=(50, 100), minimum_increase=(10, 100))
INVOLVEMENT = dict(minimum_recent=10, minimum_baseline=8)
TP = "t.match_id, t.team_id, t.period, t.sequence, t.elapsed_seconds, t.event_id, t.minute"
part("tilt", "select * from me where event_type = 'pass' and completed and open_play and x >= 80")
part("tchk", f"""select {TP}, count(f.event_id) filter (where {REC} and f.team_id = t.team_id) as recent_value, count(f.event_id) filter (where {REC}) as recent_base,
  count(f.event_id) filter (where not ({REC}) and f.team_id = t.team_id) as earlier_value, count(f.event_id) filter (where not ({REC})) as earlier_base
  from trig_all t left join tilt f on f.match_id = t.match_id and f.sequence <= t.sequence group by {TP}""")
part("tout", """select *, case when recent_base < 5 or earlier_base < 10 then 'insufficient_data'
  when 2 * recent_value >= recent_base and 10 * (recent_value * earlier_base - earlier_value * recent_base) >= recent_base * earlier_base then 'card' else 'no_change' end as outcome from tchk""")
part("tcard", "select * from tout where outcome = 'card'")
part("cchk", f"""select {TP}, count(f.event_id) filter (where {REC}) as recent_value, cast(600 as bigint) as recent_base, count(f.event_id) filter (where not ({REC})) as earlier_value,
  cast((select coalesce(sum(l.pl_last - p.ps), 0) from plast l join pst p using (match_id, period) where l.match_id = t.match_id and l.period < t.period)
   + greatest(0, t.elapsed_seconds - 600 - max(t.ps)) as bigint) as earlier_base
  from trig_all t left join shots2 f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence group by {TP}""")
part("cout", """select *, case when earlier_base < 1200 then 'insufficient_data'
  when recent_value >= 3 and (earlier_value = 0 or recent_value * earlier_base >= 2 * earlier_value * recent_base) then 'card' else 'no_change' end as outcome from cchk""")
part("ccard", "select * from cout where outcome = 'card'")
part("optp", "select * from me where event_type = 'pass' and open_play")
part("teamp", f"""select {TP}, count(f.event_id) filter (where {REC}) as recent_team from trig_all t
  left join optp f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence group by {TP}""")
part("pons", """select p.match_id, p.team_id, p.sequence, o.player_id from optp p join onp o on o.match_id = p.match_id and o.team_id = p.team_id
  and o.on_sequence <= p.sequence and (o.off_sequence is null or p.sequence < o.off_sequence)""")
part("plchk", f"""select t.match_id, t.team_id, t.sequence, o.player_id,
  count(f.event_id) filter (where {REC} and f.player_id = o.player_id) as mine,
  count(f.event_id) filter (where not ({REC}) and f.player_id = o.player_id and n.player_id is not null) as was,
  count(f.event_id) filter (where not ({REC}) and n.player_id is not null) as was_base
  from trig_all t join onp o on o.match_id = t.match_id and o.team_id = t.team_id and o.on_sequence <= t.sequence and (o.off_sequence is null or t.sequence < o.off_sequence)
  left join optp f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence
  left join pons n on n.match_id = f.match_id and n.team_id = f.team_id and n.sequence = f.sequence and n.player_id = o.player_id
  group by t.match_id, t.team_id, t.sequence, o.player_id""")
part("icomb", """select p.match_id, p.team_id, p.sequence, p.player_id, mine, was, was_base, recent_team, was_base >= 8 as evaluable,
  was_base >= 8 and 100 * mine >= 20 * recent_team and 100 * (mine * was_base - was * recent_team) >= 10 * recent_team * was_base as fires,
  round(cast(mine as double) / nullif(recent_team, 0) - cast(was as double) / nullif(was_base, 0), 12) as inc
  from plchk p join teamp using (match_id, team_id, sequence) where recent_team >= 10""")
part("ibest", """select match_id, team_id, sequence, bool_or(evaluable) as anyone, bool_or(fires) as fires from icomb group by all""")
part("ipick", """select * from (select *, row_number() over (partition by match_id, team_id, sequence order by inc desc, player_id) as rn from icomb where fires) where rn = 1""")
part("iout", """select t.match_id, t.team_id, period, t.sequence, elapsed_seconds, event_id, minute,
  case when not coalesce(anyone, false) then 'insufficient_data' when k.player_id is not null then 'card' else 'no_change' end as outcome,
  k.mine as recent_value, t.recent_team as recent_base, k.was as earlier_value, k.was_base as earlier_base, k.player_id
  from teamp t left join ibest b on b.match_id = t.match_id and b.team_id = t.team_id and b.sequence = t.sequence
  left join ipick k on k.match_id = t.match_id and k.team_id = t.team_id and k.sequence = t.sequence""")
part("icard", "select * from iout where outcome = 'card'")
PROTO = "match_id, team_id, period, sequence, elapsed_seconds, event_id, minute, recent_value, recent_base, earlier_value, earlier_base"


def _territory(i: Inputs):
    return D.territory_checks(i.events, **TERRITORY)


def _involvement(i: Inputs):
    return D.involvement_checks(i.events, i.presence_changes, **INVOLVEMENT)


@query("h12_territory_cards", f"with {fired('tf', 'tcard')} select {PROTO} from tcard join tf using (match_id, team_id, period, sequence, elapsed_seconds)", recursive=True)
def _(i: Inputs):
    return D.checked_cards(_territory(i))


@query("h13_involvement_cards", f"with {fired('ivf', 'icard')} select {PROTO}, player_id from icard join ivf using (match_id, team_id, period, sequence, elapsed_seconds)", recursive=True)
def _(i: Inputs):
    return D.checked_cards(_involvement(i))


@query("h14_chances_cards", f"with {fired('cf', 'ccard')} select {PROTO} from ccard join cf using (match_id, team_id, period, sequence, elapsed_seconds)", recursive=True)
def _(i: Inputs):
    return D.checked_cards(D.chances_checks(i.events))


@query("h15_detector_outcomes", f"""with {fired('tf', 'tcard')} select match_id, team_id, period, minute, arg_max(outcome, sequence) as outcome from tout t
  where not exists (select 1 from tf f where f.match_id = t.match_id and f.team_id = t.team_id and f.period = t.period and f.sequence < t.sequence and t.elapsed_seconds < f.elapsed_seconds + 600)
  group by match_id, team_id, period, minute""", recursive=True)
def _(i: Inputs):
    return D.detector_outcomes(_territory(i))


# --- text ---------------------------------------------------------------------------------

TEAMS_SQL = "(select 1 as team_id, 'Rovers' as team_name union all select 2, 'City')"


def _teams(i: Inputs):
    return i.spark.createDataFrame([(1, "Rovers"), (2, "City")], "team_id int, team_name string")


def pct(n: str, d: str) -> str:
    return f"(case when {d} = 0 then 0 else (200 * {n} + {d}) // (2 * {d}) end)"


def picked(prefix: str) -> str:
    return f"(case channel when 'left' then {prefix}_left when 'center' then {prefix}_center else {prefix}_right end)"


PR, PB = picked("recent"), picked("baseline")
LARGER = "list_filter([{'c': 'left', 'n': recent_left}, {'c': 'center', 'n': recent_center}, {'c': 'right', 'n': recent_right}], lambda s: s.n > " + PR + ")"
SHIFT_TEXT = f"""'More of ' || (case when team_name like '%s' then team_name || chr(39) else team_name || chr(39) || 's' end) || ' final-third entries are ending '
  || (case channel when 'left' then 'on the left' when 'center' then 'in the center' else 'on the right' end) || ': ' || {PR} || ' of the last ' || r || ' (' || {pct(PR, 'r')}
  || '%), up from ' || {PB} || ' of ' || b || ' (' || {pct(PB, 'b')} || '%) earlier.' || (case len(lg) when 0 then '' when 1 then ' The ' || lg[1].c || ' has more: ' || lg[1].n || '.'
  else ' The ' || lg[1].c || ' (' || lg[1].n || ') and the ' || lg[2].c || ' (' || lg[2].n || ') have more.' end)"""
BURST_TEXT = """team_name || ': ' || recent_shots || (case when recent_shots = 1 then ' shot' else ' shots' end) || ' in the last 10 minutes, after '
  || (case when earlier_shots = 0 then 'none' else cast(earlier_shots as varchar) end) || ' in the previous ' || cast(earlier_seconds as bigint) // 60
  || ' minutes of play. Final-third entries in the last 10 minutes: ' || recent_entries || '.'"""


def dashes(c: str) -> str:
    return f"array_to_string(string_split({c}, ''), '-')"


FACT_TEXT = f"""case kind when 'lineup' then team_name || ' started in a recorded ' || {dashes('formation')} || ' shape.'
  when 'substitution' then 'Player ' || player_on_id || ' replaced Player ' || player_off_id || ' for ' || team_name || '.'
  else 'The recorded formation for ' || team_name || ' changed from ' || {dashes('previous_formation')} || ' to ' || {dashes('formation')} || '.' end"""


@query("h16_render_cards", f"""with {SHIFT_CARDS}, {BURST_CARDS} select match_id, team_id, sequence, event_id, 'side_shift' as kind, {SHIFT_TEXT} as sentence from (select *, {LARGER} as lg from shifts) join {TEAMS_SQL} using (team_id)
  union all select match_id, team_id, sequence, event_id, 'burst', {BURST_TEXT} from bursts join {TEAMS_SQL} using (team_id)
  union all select match_id, team_id, sequence, event_id, kind, {FACT_TEXT} from facts join {TEAMS_SQL} using (team_id)""", recursive=True)
def _(i: Inputs):
    return K.render_cards(_shifts(i), _bursts(i), D.recorded_facts(i.facts), _teams(i))


def channel_row(k: int, c: str) -> str:
    r, b = f"recent_{c}", f"baseline_{c}"
    change = f"((200 * ({r} * b - {b} * r) + r * b + 1000000 * 2 * r * b) // (2 * r * b) - 1000000)"
    return f"""select match_id, team_id, sequence as card_sequence, 2 as section, {k} as position, '  ' || rpad('{c}', 8, ' ') || rpad({r} || ' of ' || r, 9, ' ') || rpad({pct(r, 'r')} || '%', 7, ' ')
   || rpad({b} || ' of ' || b, 9, ' ') || rpad({pct(b, 'b')} || '%', 7, ' ') || printf('%+d', cast({change} as bigint)) || ' points' as text from shifts"""


SHIFT_EV = f"""select t.match_id, t.team_id, t.sequence as card_sequence, case when {REC} then 'recent' else 'baseline' end as role, f.*
   exclude (match_id, team_id) from shifts t join entm f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence"""
SHIFT_LINES = f"""select match_id, team_id, sequence as card_sequence, 1 as section, 0 as position, '  channel recent          baseline        change' as text from shifts
  union all {" union all ".join(channel_row(k, c) for k, c in enumerate(D.CHANNELS))}
  union all select match_id, team_id, sequence, 3, 0, '  recent window entries (period ' || period || '):' from shifts
  union all select match_id, team_id, card_sequence, 4, sequence, printf('    period %d, %02d:%02d  %-5s  (%5.1f, %4.1f) -> (%5.1f, %4.1f)  %s', period, minute, second, event_type, x, y, end_x, end_y, ch) from ({SHIFT_EV}) where role = 'recent'
  union all select match_id, team_id, sequence, 5, 0, '  baseline entries by period:' from shifts
  union all select match_id, team_id, card_sequence, 6, period, '    period ' || period || ': left ' || count(*) filter (where ch = 'left') || ', center ' || count(*) filter (where ch = 'center') || ', right ' || count(*) filter (where ch = 'right')
   from ({SHIFT_EV}) where role = 'baseline' group by match_id, team_id, card_sequence, period"""


@query("h17_render_evidence", f"with {SHIFT_CARDS} {SHIFT_LINES}", recursive=True)
def _(i: Inputs):
    return K.render_evidence(_shifts(i), i.events)


BURST_LINES = f"""select match_id, team_id, sequence as card_sequence, 1 as section, 0 as position, '  recent shots (' || recent_shots || '):' as text from bursts
  union all select match_id, team_id, sequence, 3, 0, '  earlier: ' || earlier_shots || ' shots and ' || earlier_entries || ' final-third entries in ' || cast(earlier_seconds as bigint) || ' seconds' from bursts
  union all select match_id, team_id, sequence, 4, 0, '  recent final-third entries: ' || recent_entries from bursts
  union all select t.match_id, t.team_id, t.sequence, 2, f.sequence, printf('    period %d, %02d:%02d  %d  at (%5.1f, %4.1f)', f.period, f.minute, f.second, f.event_id, f.x, f.y)
   from bursts t join me f on f.match_id = t.match_id and f.team_id = t.team_id and f.sequence <= t.sequence and {REC} where f.event_type = 'shot' and not f.penalty"""


@query("h17_burst_evidence", f"with {BURST_CARDS} {BURST_LINES}", recursive=True)
def _(i: Inputs):
    return K.render_burst_evidence(_bursts(i), i.events)


@query("h17_fact_evidence", """select match_id, team_id, sequence, kind, 0 as position, '  ' || case when kind = 'formation_change' then 'previous formation event: ' || previous_event_id else 'recorded event: ' || event_id end || ' (bridge)' as text from facts
  union all select match_id, team_id, sequence, kind, 1, '  new formation event: ' || event_id || ' (bridge)' from facts where kind = 'formation_change'""")
def _(i: Inputs):
    return K.render_fact_evidence(D.recorded_facts(i.facts), "bridge")


# --- replay position ----------------------------------------------------------------------

part("recp", """select match_id, period, arg_min(elapsed_seconds, sequence) filter (where event_type = 'pressure') as s,
  arg_max(elapsed_seconds, sequence) filter (where event_type = 'ball_recovery') as e from me group by match_id, period having s is not null and e is not null""")
part("seg", """select match_id, period, s, greatest(s, e) - s as len, cast(coalesce(sum(greatest(s, e) - s) over (partition by match_id order by period
  rows between unbounded preceding and 1 preceding), 0) as bigint) as off from recp""")
ASKED = 3000


def _periods(i: Inputs):
    kind = F.when(F.col("event_type") == "pressure", "period_start").when(F.col("event_type") == "ball_recovery", "period_end")
    return K.timeline(S.recorded_periods(i.events.withColumn("event_type", kind)))


@query("h18_as_of_snapshot", f"""with {STREAM}, items as (select match_id, period, sequence, minute, second, 'goal' as item, home_score_after as h, away_score_after as a from sa where scores_goal
   union all select match_id, period, sequence, minute, second, 'card', null, null from stream union all select match_id, period, sequence, minute, second, 'fact', null, null from facts),
  placed as (select i.*, off + least(greatest(minute * 60 + second - s, 0), len) as position from items i join seg using (match_id, period)),
  tot as (select match_id, sum(len) as total from seg group by match_id),
  hit as (select match_id, arg_min(period, period) as period, arg_min(s + least({ASKED}, total) - off, period) as sec from seg join tot using (match_id) where least({ASKED}, total) <= off + len group by match_id)
  select h.match_id, cast({ASKED} as bigint) as position, h.period, cast(sec // 60 as int) as minute, cast(sec % 60 as int) as second,
   coalesce(arg_max(p.h, p.sequence) filter (where item = 'goal'), 0) as home_score, coalesce(arg_max(p.a, p.sequence) filter (where item = 'goal'), 0) as away_score,
   count(*) filter (where item = 'goal') as goals, count(*) filter (where item = 'card') as cards, count(*) filter (where item = 'fact') as facts
  from hit h left join placed p on p.match_id = h.match_id and p.position <= {ASKED} group by h.match_id, h.period, sec""", recursive=True)
def _(i: Inputs):
    asks = i.matches.select("match_id", F.lit(ASKED).cast("bigint").alias("position"))
    return K.as_of_snapshot(S.goal_timeline(i.events, i.matches), _stream(i), D.recorded_facts(i.facts), _periods(i), asks)


@query("h19_unread_cards", f"""with {STREAM}, un as (select *, event_id % 3 = 0 as was_read from stream)
  select m.match_id, case when count(u.card_id) = 0 then 'off' when count(*) filter (where not was_read) > 0 then 'new' else 'seen' end as state,
   count(*) filter (where not was_read) as new_count,
   coalesce(arg_max(card_id, sequence * 2 + kind_rank) filter (where not was_read), arg_max(card_id, sequence * 2 + kind_rank)) as opens
  from ma m left join un u using (match_id) group by m.match_id""", recursive=True)
def _(i: Inputs):
    stream = _stream(i)
    return K.unread_cards(stream, stream.where("event_id % 3 = 0"), i.matches)
