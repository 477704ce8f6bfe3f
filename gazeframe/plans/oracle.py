"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from gazeframe.operators.labels import weight_sets
from gazeframe.plans.driver_tables import SYSTEMS
from gazeframe.plans.queries import PERMUTATIONS, REPLICATES, RESAMPLES, SEED, SHUFFLES
from gazeframe.functions import text
from gazeframe.schema import LABELS


def _u(*parts: str) -> str:
    """md5 integer of the parts joined by '|'."""
    return f"cast(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) as bigint)"


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0::double as {name}"


FRAMES = """frames0 as (
select 'u' || user_id as clip, 'u' || user_id || ':person_1' as child_id, 1 as person_id,
  cast(row_number() over (partition by user_id order by ts, event_id) as int) as frame,
  cast(event_id % 50 as double) bbox_x, cast(event_id % 40 as double) bbox_y,
  cast(40 + event_id % 20 as double) bbox_width, cast(40 + event_id % 25 as double) bbox_height,
  case when user_id % 2 = 0 and event_id % 5 <> 0 then 'inside_visible'
       when user_id % 7 = 0 and event_type in ('signup', 'error') then 'eyes_closed'
       when user_id % 11 = 0 and event_type in ('signup', 'click') then 'inside_uncertain'
       when event_type = 'view' then 'inside_visible' when event_type = 'click' then 'gaze_shift'
       when event_type = 'purchase' then 'inside_occluded' when event_type = 'signup' then 'outside_frame'
       when event_id % 3 = 0 then 'inside_ambiguous' else 'eyes_closed' end as gaze_class,
  value * (case when user_id % 4 = 0 then 0.1::double else 1.0::double end) gaze_x,
  cast(event_id % 97 as double) * (case when user_id % 4 = 0 then 0.1::double else 1.0::double end) gaze_y,
  case when user_id % 10 = 0 then 0 else 1 end is_child,
  case user_id % 3 when 0 then 2.4::double when 1 then 2.5::double else 3.0::double end fps,
  user_id % 10 channel_id, user_id % 21 video_id
from events),
frames as (select * from frames0 where is_child = 1)"""

_VIS, _HID = "gaze_class = 'inside_visible'", "gaze_class in ('inside_occluded', 'inside_uncertain')"

FEATURES = f"""{FRAMES},
basic as (
select child_id, count(*) observed_frames, avg(case when {_VIS} then 1.0 else 0.0 end) visible_ratio,
  avg(case when {_VIS} or {_HID} then 1.0 else 0.0 end) on_screen_ratio,
  avg(case when gaze_class = 'gaze_shift' then 1.0 else 0.0 end) gaze_shift_ratio,
  count(*) filter (gaze_class = 'gaze_shift') gaze_shift_events,
  avg(case when {_HID} then 1.0 else 0.0 end) occlusion_ratio,
  avg(case when gaze_class = 'eyes_closed' then 1.0 else 0.0 end) eyes_closed_ratio,
  avg(bbox_width * bbox_height) mean_head_area
from frames group by 1),
head as (
select child_id, coalesce(avg(step), 0.0) mean_head_motion from (
  select child_id, sqrt(power(bbox_x + bbox_width / 2 - lag(bbox_x + bbox_width / 2) over w, 2) + power(bbox_y + bbox_height / 2 - lag(bbox_y + bbox_height / 2) over w, 2)) step
  from frames window w as (partition by child_id order by frame)) group by 1),
gaze as (
select child_id, avg(step) mean_gaze_motion from (
  select child_id, sqrt(power(gaze_x - lag(gaze_x) over w, 2) + power(gaze_y - lag(gaze_y) over w, 2)) step
  from frames where {_VIS} window w as (partition by child_id order by frame)) group by 1),
runs as (
select child_id, vis, hid, frame - row_number() over (partition by child_id, vis order by frame) g_vis, frame - row_number() over (partition by child_id, hid order by frame) g_hid
from (select child_id, frame, {_VIS} vis, {_HID} hid from frames)),
streaks as (
select child_id, coalesce(max(n) filter (k = 'v'), 0) max_visible_streak, coalesce(max(n) filter (k = 'h'), 0) max_occlusion_streak from (
  select child_id, 'v' k, count(*) n from runs where vis group by child_id, g_vis union all select child_id, 'h', count(*) from runs where hid group by child_id, g_hid) group by 1),
dominant as (
select child_id, gaze_class dominant_gaze_class from (
  select child_id, gaze_class, row_number() over (partition by child_id order by count(*) desc, min(frame)) r from frames group by child_id, gaze_class) where r = 1),
features as (
select b.*, h.mean_head_motion, coalesce(g.mean_gaze_motion, 0.0) mean_gaze_motion, coalesce(s.max_visible_streak, 0) max_visible_streak, coalesce(s.max_occlusion_streak, 0) max_occlusion_streak,
  d.dominant_gaze_class, b.visible_ratio visible_gaze_fraction,
  greatest(0.0::double, least(1.0::double, 0.45::double * visible_ratio + 0.25::double * (coalesce(s.max_visible_streak, 0) / observed_frames)
    + 0.15::double * (1.0::double - least(coalesce(g.mean_gaze_motion, 0.0) / 300.0::double, 1.0::double)) + 0.15::double * (1.0::double - gaze_shift_ratio))) attention_stability_score
from basic b join head h using (child_id) left join gaze g using (child_id) left join streaks s using (child_id) join dominant d using (child_id))"""

SEGMENTS = f"""{FRAMES},
typed as (
select *, case when {_HID} then 'occluded' when gaze_class = 'outside_frame' then 'outside' when gaze_class = 'eyes_closed' then 'eyes_closed' when gaze_class = 'gaze_shift' then 'shift'
  when {_VIS} then case when lag(gaze_class) over w = 'inside_visible' and sqrt(power(gaze_x - lag(gaze_x) over w, 2) + power(gaze_y - lag(gaze_y) over w, 2)) >= 60 then 'shift' else 'stable' end
  else 'uncertain' end segment_type
from frames window w as (partition by child_id order by frame)),
marked as (select *, case when segment_type = lag(segment_type) over (partition by child_id order by frame) then 0 else 1 end starts from typed),
numbered as (select *, cast(sum(starts) over (partition by child_id order by frame) - 1 as int) segment_index from marked),
segs as (
select child_id, segment_index, any_value(segment_type) segment_type, min(frame) start_frame, max(frame) end_frame, arg_min(gaze_class, frame) gaze_class,
  avg(gaze_x) filter ({_VIS}) avg_gaze_x, avg(gaze_y) filter ({_VIS}) avg_gaze_y, count(*) frame_count,
  round((min(frame) - 1) / any_value(fps), 4) start_time, round(max(frame) / any_value(fps), 4) end_time, round((max(frame) - min(frame) + 1) / any_value(fps), 4) duration
from numbered group by child_id, segment_index),
spanning as (
select child_id, cast(count(*) as int) interaction_index, 'exploratory_behavior' interaction_type, min(start_time) start_time, max(end_time) end_time, round(max(end_time) - min(start_time), 4) duration,
  string_agg(cast(segment_index as varchar), ',' order by segment_index) filter (segment_type = 'shift') supporting
from segs group by child_id having count(*) filter (segment_type = 'shift') >= 3),
events_of as (
select child_id, segment_index interaction_index, case when segment_type = 'stable' and duration >= 1.0 then 'focused_attention' when segment_type = 'shift' then 'attention_shift'
  when segment_type in ('occluded', 'outside', 'eyes_closed') then 'reduced_visual_availability' else 'monitoring' end interaction_type, start_time, end_time, duration, cast(segment_index as varchar) supporting
from segs union all select * from spanning)"""

_STATUS = "case o_orderstatus when 'O' then 'focused' when 'F' then 'mix' else 'others' end"
_URGENT = "case substr(o_orderpriority, 1, 1) when '1' then 'focused' when '2' then 'mix' when '3' then 'mix' else 'others' end"
RATINGS = f"""rated as (
select o_orderkey item_id, c_nationkey as cluster, o_custkey fine_cluster, {_STATUS} rater1, case when {_u("'r2'", "o_orderkey")} % 100 < 70 then {_STATUS} else {_URGENT} end rater2
from orders join customer on o_custkey = c_custkey),
ratings as (select *, case when rater1 = rater2 or {_u("'consensus'", "item_id")} % 2 = 0 then rater1 else rater2 end consensus from rated)"""

_GRID = ", ".join(f"('{s}', {e})" for s, e in SYSTEMS)
PREDICTIONS = f"""{RATINGS},
systems(system, error) as (values {_GRID}),
drawn as (select system, error, item_id, consensus, {_u("'label'", "system", "item_id")} u from ratings cross join systems),
predictions as (
select system, item_id, case when system = 'nli_bart' and {_u("'missing'", "item_id")} % 20 = 0 then null when error < 0 then 'focused'
  when u % 100 < error then (['focused', 'mix', 'others'])[cast((list_position(['focused', 'mix', 'others'], consensus) + u // 100 % 2) % 3 + 1 as int)] else consensus end as label,
  round(({_u("'confidence'", "system", "item_id")} % 101) / 100.0::double, 2) confidence
from drawn)"""

CONSENSUS = f"""{PREDICTIONS},
rows_ as (select p.*, consensus as truth from predictions p join ratings using (item_id))"""

LONG = f"""{PREDICTIONS},
long_ as (
select system, item_id, label, cluster, 'rater1' as reference, rater1 truth from predictions join ratings using (item_id) union all
select system, item_id, label, cluster, 'rater2', rater2 from predictions join ratings using (item_id) union all
select system, item_id, label, cluster, 'consensus', consensus from predictions join ratings using (item_id)),
known as (select *, 1.0::double w from long_ where label is not null and truth is not null)"""


def _scores(source: str, by: str, name: str = "scores") -> str:
    """All metrics from weighted rows (by, truth, label, w)."""
    tot = lambda cond: f"coalesce(sum(w) filter ({cond}), 0.0)"
    cols = ", ".join([f"{tot(f"truth = '{c}' and label = '{c}'")} h{k}, {tot(f"truth = '{c}'")} t{k}, {tot(f"label = '{c}'")} l{k}" for k, c in enumerate(LABELS)])
    chance = " + ".join(f"(t{k} / n) * (l{k} / n)" for k in range(3))
    pi = [f"((t{k} + l{k}) / (2 * n))" for k in range(3)]
    return f"""{name}_0 as (select {by}, sum(w) n, {cols} from {source} group by {by}),
{name}_1 as (select *, (h0 + h1 + h2) / n po, {chance} pe, ({" + ".join(f"{p} * (1 - {p})" for p in pi)}) / 2 pa,
  {", ".join(f"case when l{k} > 0 then h{k} / l{k} else 0.0 end p{k}, case when t{k} > 0 then h{k} / t{k} else 0.0 end r{k}, case when t{k} + l{k} > 0 then 2 * h{k} / (t{k} + l{k}) else 0.0 end f{k}" for k in range(3))}
  from {name}_0),
{name} as (select *, po accuracy, case when pe < 1 then (po - pe) / (1 - pe) end kappa, (po - pa) / (1 - pa) ac1,
  list_avg(list_filter([{", ".join(f"case when t{k} > 0 then r{k} end" for k in range(3))}], lambda x: x is not null)) balanced_accuracy,
  (f0 + f1 + f2) / 3 macro_f1,
  list_avg(list_filter([{", ".join(f"case when t{k} + l{k} > 0 then f{k} end" for k in range(3))}], lambda x: x is not null)) macro_f1_union,
  list_avg(list_filter([{", ".join(f"case when t{k} > 0 then f{k} end" for k in range(3))}], lambda x: x is not null)) macro_f1_present,
  (t0 * f0 + t1 * f1 + t2 * f2) / n weighted_f1, po - greatest(t0, t1, t2) / n majority_gain, greatest(l0, l1, l2) / n top_share from {name}_1)"""


METRIC_NAMES = ["accuracy", "balanced_accuracy", "kappa", "ac1", "macro_f1", "macro_f1_union", "macro_f1_present", "weighted_f1", "majority_gain", "top_share"]
SCORES = f"{LONG},\n{_scores('known', 'system, reference')}"
WIDE = f"""{SCORES},
wide_ as (select system, max(kappa) filter (reference = 'rater1') rater1, max(kappa) filter (reference = 'rater2') rater2, max(kappa) filter (reference = 'consensus') consensus,
  bool_and(top_share < 0.95) filter (reference = 'consensus') varied from scores group by 1)"""
_FAMILY = """case when starts_with(lower(system), 'rule_based') then 'rule' when contains(lower(system), 'llm_') then 'llm' when contains(lower(system), 'dummy') then 'dummy'
  when starts_with(lower(system), 'supervised_') then 'supervised' when lower(system) in ('bart', 'deberta', 'distilbert') or starts_with(lower(system), 'nli_') then 'nli' else 'supervised' end"""
_RULE = """case when eyes_closed_ratio >= 0.3 then 'others' when occlusion_ratio >= 0.35 then 'others'
  when visible_ratio >= 0.75 and gaze_shift_ratio <= 0.1 and mean_gaze_motion <= 120 and {score} >= 0.65 then 'focused' else 'mix' end"""
_PLAIN = "case dominant_gaze_class when 'inside_visible' then 'focused' when 'gaze_shift' then 'mix' else 'others' end"

MCNEMAR = f"""{CONSENSUS},
hits as (select system, item_id, label = truth ok from rows_ where label is not null),
pairs as (select x.system system_a, y.system system_b, count(*) filter (x.ok and not y.ok) b, count(*) filter (y.ok and not x.ok) c from hits x join hits y on x.item_id = y.item_id and x.system < y.system group by 1, 2),
terms as (select system_a, system_b, b, c, unnest(generate_series(0, least(b, c))) k from pairs),
tests as (select system_a, system_b, b, c, case when b + c = 0 then 1.0 else least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0)))) end p from terms group by 1, 2, 3, 4)"""

def _boot(cluster: str = "cluster") -> str:
    """Replicates of clusters; ``cluster`` is an expression over ratings."""
    return f"""{PREDICTIONS},
units as (select *, {cluster} as unit from ratings),
names as (select list_sort(list(distinct unit)) names from units),
reps as (select unnest(generate_series(0, {REPLICATES - 1})) rep),
draws as (select rep, unnest(generate_series(1, len(names))) draw, names from reps, names),
weights as (select rep, unit, count(*) w from (select rep, names[cast({_u(f"'{SEED}'", "rep", "draw")} % len(names) + 1 as int)] as unit from draws) group by 1, 2)"""


def _replicates(source: str, by: str, reference: str = "") -> str:
    """Scores by replicate of rows (by, unit, truth, label) of ``source``."""
    return f"""cells_ as (select {by}, unit, truth, label, count(*) c from ({source}) where label is not null group by all),
weighed as (select rep, {by}, truth, label, c * w::double w from cells_ join weights using (unit)),
{_scores('weighed', f'rep, {by}')}"""


_ALL_REFERENCES = " union all ".join(f"select system, '{r}' as reference, unit, {r} truth, label from predictions join units using (item_id)" for r in ("rater1", "rater2", "consensus"))
BOOT = f"{_boot()},\n{_replicates(_ALL_REFERENCES, 'system, reference')}"
BOOT_VIDEO = f"{_boot('fine_cluster % 21')},\n{_replicates(_ALL_REFERENCES, 'system, reference')}"
DELTAS = f"""{BOOT},
deltas as (select rep, system, max(kappa) filter (reference = 'rater1') - max(kappa) filter (reference = 'rater2') delta from scores group by 1, 2)"""


def _ci(v: str) -> str:
    return f"{_r(f'quantile_cont({v}, 0.025)', v + '_lo')}, {_r(f'quantile_cont({v}, 0.975)', v + '_hi')}, count(*) filter ({v} is null) {v}_undefined"


def _poisson(u: str) -> str:
    total, p, steps = 0.0, 2.718281828459045**-1, []
    for k in range(12):
        total += p
        steps.append(repr(total))
        p /= k + 1
    return f"len(list_filter([{', '.join(s + '::double' for s in steps)}], lambda s: s <= {u}))"


GENERATIONS = f"""{PREDICTIONS},
generated as (select *, {_u("'kind'", "system", "item_id")} % 16 kind from predictions where system like 'llm%'),
parsed as (select system, item_id, case when kind = 4 then 'mix' when kind not in (5, 10, 13, 15) then label end as label, case when kind = 12 then 1.0::double when kind not in (5, 10, 13, 15) then confidence end as confidence,
  case when kind in (4, 8, 9, 11) then 'invalid_label' when kind in (5, 10, 13, 15) then 'no_json' else 'ok' end as status, kind, label given, confidence stated from generated)"""
_OBJ = """'{"label": "' || given || '", "confidence": ' || printf('%.2f', stated) || ', "reasoning": "seen in the clip"}'"""
_RAW = f"""case kind when 0 then {_OBJ} when 1 then '```json' || chr(10) || {_OBJ} || chr(10) || '```' when 2 then 'Sure, here it is: ' || {_OBJ} || ' Hope this helps.'
  when 3 then '  ' || substr({_OBJ}, 1, length({_OBJ}) - 1) when 4 then '{{"label": "banana", "confidence": ' || printf('%.2f', stated) || '}}' when 5 then 'I cannot tell, maybe ' || given when 6 then {_OBJ} || chr(10)
  when 7 then chr(10) || chr(9) || ' ' || {_OBJ} || ' ' || chr(13) || chr(10) || chr(9)
  when 8 then chr(10) || '{{"label": "\\t' || upper(substr(given, 1, 1)) || substr(given, 2) || ' \\n", "confidence": ' || printf('%.2f', stated) || '}}' || chr(10)
  when 10 then '{{"label": "' || given || '", "confidence": ' || printf('%.2f', stated) || ', "reasoning": "first line' || chr(10) || 'second line"}}'
  when 11 then '{{"label": "banana", "confidence": 2, "label": "' || given || '", "confidence": ' || printf('%.2f', stated) || '}}' when 12 then '{{"label": "' || given || '", "confidence": true}}' when 13 then '[' || {_OBJ} || ']'
  when 14 then '{{"confidence": " ' || printf('%.2f', stated) || '", "label": "' || given || '"}}' when 15 then '{{"label": "' || given || '", "confidence": NaN}}'
  else 'The answer:' || chr(10) || '```' || chr(10) || '{{"label": "rather \\"' || given || '\\" I think", "confidence": ' || printf('%.2f', stated) || chr(10) || '```' || chr(10) end"""
_OLD = "case given when 'focused' then 'inside_visible' when 'mix' then 'outside' else 'unsure' end"



def _inverse(source: str, name: str, u: str, first: str, last: str, ratio: str) -> str:
    """CTE ``name``: ``source`` and the count ``name`` drawn by the inverse of a distribution whose neighbours have this ratio at k = x.k."""
    step = f"'k': y.k, 'w': x.w * ({ratio}), 's': x.s + x.w * ({ratio})"
    return f"""{name}_b as (select *, {u} u_, {first} first_, {last} last_ from {source}),
{name}_k as (select *, list_transform(range(cast(first_ as bigint), cast(last_ as bigint) + 1), lambda k: {{'k': k::double, 'w': 1.0::double, 's': 1.0::double, 'c': 0::bigint}}) ks_ from {name}_b),
{name}_t as (select *, list_reduce(ks_, lambda x, y: {{{step}, 'c': 0::bigint}}).s total_ from {name}_k),
{name} as (select * exclude (u_, first_, last_, ks_, total_), first_ + list_reduce(ks_, lambda x, y: {{{step}, 'c': x.c + case when x.s < u_ * total_ then 1 else 0 end}}).c as {name} from {name}_t)"""


def _hypergeometric(source: str, name: str, u: str, population: str, special: str, size: str) -> str:
    share = f"({special} / greatest({population}, 1.0))"
    spread = f"(8.0 * sqrt({size} * {share} * (1.0 - {share}) * ({population} - {size}) / greatest({population} - 1, 1.0)) + 8.0)"
    first = f"greatest(0.0, {size} - ({population} - {special}), floor({size} * {share} - {spread}))"
    last = f"least({special}, {size}, ceil({size} * {share} + {spread}))"
    return _inverse(source, name, u, first, last, f"({special} - x.k) * ({size} - x.k) / ((x.k + 1) * ({population} - {special} - {size} + x.k + 1))")


def _binomial(source: str, name: str, u: str, size: str, share: str) -> str:
    spread = f"(8.0 * sqrt({size} * {share} * (1.0 - {share})) + 8.0)"
    first = f"case when {share} >= 1 then {size} else greatest(0.0, floor({size} * {share} - {spread})) end"
    last = f"case when {share} >= 1 then {size} else least({size}, ceil({size} * {share} + {spread})) end"
    return _inverse(source, name, u, first, last, f"({size} - x.k) / (x.k + 1) * ({share} / (1.0 - {share}))")


_KINDS = [(a, b) for a in LABELS for b in LABELS]


def _resampled(rows: str, by: list[str], seed: int) -> str:
    """CTEs up to ``weighed`` (rep, by, truth, label, w): resamples on nine cells."""
    keys = ", ".join(by)
    counts = ", ".join(f"cast(count(*) filter (truth = '{t}' and label = '{y}') as double) n{i}" for i, (t, y) in enumerate(_KINDS))
    out = [f"m_ as (select {keys}, {counts} from {rows} group by {keys}), d_ as (select * from m_ cross join (select unnest(generate_series(0, {RESAMPLES - 1})) rep))"]
    source = "d_"
    for i in range(9):
        rest = "(" + " + ".join(f"n{j}" for j in range(i, 9)) + ")"
        size = "(" + " + ".join(f"n{j}" for j in range(9)) + "".join(f" - x{j}" for j in range(i)) + ")"
        u = f"({_u(f"'{seed}'", *by, 'rep', f"'{i}'")} + 0.5) / 4294967296.0::double"
        out.append(_binomial(source, f"x{i}", u, size, f"(case when n{i} >= {rest} then 1.0 else n{i} / greatest({rest}, 1.0) end)::double"))
        source = f"x{i}"
    out.append("weighed as (" + " union all ".join(f"select rep, {keys}, '{t}' truth, '{y}' as label, cast(x{i} as double) w from (select * from x8) t_" for i, (t, y) in enumerate(_KINDS)) + ")")
    return ",\n".join(out)


def _kappa_of(truth: str, label: str) -> str:
    agree = f"avg(case when {truth} = {label} then 1.0::double else 0.0::double end)"
    chance = " + ".join(f"avg(case when {truth} = '{c}' then 1.0::double else 0.0::double end) * avg(case when {label} = '{c}' then 1.0::double else 0.0::double end)" for c in LABELS)
    return f"({agree} - ({chance})) / nullif(1.0 - ({chance}), 0)"


def _shuffled() -> str:
    """CTEs up to ``null_`` (system, rep, delta): labels shuffled over items, on 27 counts a system."""
    counts = ", ".join(f"cast(count(*) filter (rater1 = '{a}' and rater2 = '{b}') as double) n{i}" for i, (a, b) in enumerate(_KINDS))
    labels = ", ".join(f"cast(count(*) filter (label = '{c}') as double) m{k}" for k, c in enumerate(LABELS))
    out = [f"m_ as (select system, {counts}, {labels}, cast(count(*) as double) total from predictions join ratings using (item_id) where label is not null group by 1), d_ as (select * from m_ cross join (select unnest(generate_series(0, {PERMUTATIONS - 1})) rep))"]
    source, left = "d_", [f"n{i}" for i in range(9)]
    for c in range(2):
        for i in range(9):
            name = f"x{c}{i}"
            size = f"(m{c}" + "".join(f" - x{c}{j}" for j in range(i)) + ")"
            u = f"({_u(f"'{SEED}'", 'system', 'rep', f"'{c}'", f"'{i}'")} + 0.5) / 4294967296.0::double"
            out.append(_hypergeometric(source, name, u, "(" + " + ".join(left[i:]) + ")", left[i], size))
            source = name
        left = [f"({x} - x{c}{i})" for i, x in enumerate(left)]
    drawn = [[f"x0{i}" for i in range(9)], [f"x1{i}" for i in range(9)], left]

    def kappa(side: int) -> str:
        hits = " + ".join(drawn[c][i] for i, p in enumerate(_KINDS) for c in range(3) if p[side] == LABELS[c])
        chance = "(" + " + ".join("(" + " + ".join(f"n{i}" for i, p in enumerate(_KINDS) if p[side] == c) + f") * m{k}" for k, c in enumerate(LABELS)) + ") / (total * total)"
        return f"case when {chance} < 1 then (({hits}) / total - {chance}) / (1.0 - {chance}) end"

    out.append(f"null_ as (select system, rep, ({kappa(0)}) - ({kappa(1)}) delta from (select * from x18) drawn_)")
    return ",\n".join(out)


VOTES = f"""{PREDICTIONS},
votes as (select item_id, count(*) filter (label = 'focused') v0, count(*) filter (label = 'mix') v1, count(*) filter (label = 'others') v2, count(label) k from predictions where system like 'llm%' group by 1)"""

ITEMS = f"""{VOTES},
items as (select item_id, consensus as truth, fine_cluster % 11 = 0 gated, p.label rule_label, v0, v1, v2 from ratings join predictions p using (item_id) join votes using (item_id) where p.system = 'rule_based')"""

ITEMS_K = f"""{VOTES}, items as (select item_id, consensus as truth, fine_cluster % 11 = 0 gated, p.label rule_label, v0, v1, v2, k from ratings join predictions p using (item_id) join votes using (item_id) where p.system = 'rule_based')"""

CONDITIONS = f"""{PREDICTIONS},
cond_0 as (select *, {_u("condition", "system", "item_id")} u2 from (select *, unnest(['C0', 'C1', 'C2']) condition from predictions where system like 'llm%')),
cond as (select system, condition, item_id, case when condition <> 'C0' and u2 % 10 < 2 then 'mix' else label end as label, case u2 % 25 when 0 then 'no_json' when 1 then 'invalid_label' else 'ok' end status from cond_0),
rule_ as (select item_id, label rule_label from predictions where system = 'rule_based'),
cond_long as (select c.system, c.condition, c.label, r.reference, r.truth, 1.0::double w from cond c join (
  select item_id, 'rater1' as reference, rater1 truth from ratings union all select item_id, 'rater2', rater2 from ratings union all select item_id, 'consensus', consensus from ratings) r using (item_id)),
{_scores('cond_long', 'system, condition, reference')},
cond_metrics as (
select system, condition, n, no_json, invalid, n_focused, n_mix, n_others, agree_with_rule, accuracy, f1_others, kappa_rater1, kappa_rater2, kappa_consensus from (
  select system, condition, count(*) n, count(*) filter (status = 'no_json') no_json, count(*) filter (status = 'invalid_label') invalid, count(*) filter (label = 'focused') n_focused, count(*) filter (label = 'mix') n_mix,
    count(*) filter (label = 'others') n_others, avg(case when label = rule_label then 1.0 else 0.0 end) agree_with_rule from cond join rule_ using (item_id) group by 1, 2) join (
  select system, condition, max(accuracy) filter (reference = 'consensus') accuracy, max(f2) filter (reference = 'consensus') f1_others, max(kappa) filter (reference = 'rater1') kappa_rater1,
    max(kappa) filter (reference = 'rater2') kappa_rater2, max(kappa) filter (reference = 'consensus') kappa_consensus from scores group by 1, 2) using (system, condition))"""

_WEIGHTS = ", ".join(f"('{n}', {', '.join(repr(float(x)) + '::double' for x in w)})" for n, w in weight_sets())
_SHORT = "regexp_replace(system, '_3class$', '')"
for _a, _b in (("llm_models_", ""), ("supervised_", ""), ("Qwen--Qwen2_5", "Qwen2.5"), ("01-ai--Yi-1_5", "Yi-1.5"), ("meta-llama--Llama-3_1", "Llama-3.1"), ("microsoft--Phi-4-mini", "Phi-4-mini"), ("mistralai--Mistral-7B-Instruct-v0_3", "Mistral-7B-v0.3"), ("-Instruct", ""), ("--", "/"), ("_", " ")):
    _SHORT = f"replace({_SHORT}, '{_a}', '{_b}')"
_FEATURE_ROUND = {c: _r(c, c) for c in ("visible_ratio", "on_screen_ratio", "gaze_shift_ratio", "occlusion_ratio", "eyes_closed_ratio", "mean_head_area", "mean_head_motion", "mean_gaze_motion", "attention_stability_score", "visible_gaze_fraction")}


def _feature_query(*columns: str) -> str:
    return f"with {FEATURES} select child_id, {', '.join(_FEATURE_ROUND.get(c, c) for c in columns)} from features"


_MODEL = ["visible_ratio", "on_screen_ratio", "gaze_shift_ratio", "gaze_shift_events", "occlusion_ratio", "eyes_closed_ratio", "mean_head_area", "mean_head_motion", "mean_gaze_motion", "attention_stability_score", "max_visible_streak", "max_occlusion_streak", "visible_gaze_fraction", "observed_frames"]
_ALPHA = "greatest({0}, {1}, {2})"


def _alpha_score(k: int, c: str) -> str:
    return f"(alpha * (case when rule_label = '{c}' then 1.0::double else 0.0::double end) + (1.0::double - alpha) * (v{k} / k))"


FEWSHOT = f"""{RATINGS},
line as (select consensus as label, cluster, item_id example_id, row_number() over (partition by consensus order by cluster, {_u("'1'", 'item_id')}, item_id) - 1 at_ from ratings),
sizes as (select label, cluster, count(*) own, min(at_) start_ from line group by 1, 2),
totals as (select label, sum(own) all_ from sizes group by 1),
targets as (select item_id, t.label, coalesce(own, 0) own, coalesce(start_, 0) start_, all_ from ratings r cross join totals t left join sizes s on s.label = t.label and s.cluster = r.cluster where all_ > coalesce(own, 0)),
drawn_at as (select *, {_u("'1'", 'item_id', 'label')} % (all_ - own) pick from targets),
chosen as (select d.item_id, d.label, example_id, cast(row_number() over (partition by d.item_id order by {_u("'1'", 'd.item_id', "'place'", 'd.label')}, d.label) as int) place
  from drawn_at d join line l on l.label = d.label and l.at_ = case when pick < start_ then pick else pick + own end)"""


def _literal(text_: str) -> str:
    return "'" + text_.replace("'", "''") + "'"


_PAYLOADS = f"""{FEATURES}, {SEGMENTS.removeprefix(FRAMES + ',')},
payload as (select f.*, num_segments, num_interactions from features f join (select child_id, count(*) num_segments from segs group by 1) using (child_id) join (select child_id, count(*) num_interactions from events_of group by 1) using (child_id)),
fields as ({" union all ".join(f"select child_id, '{c}' feature, cast({c} as double) v, observed_frames o from payload" for c in text.PAYLOAD if c != "dominant_gaze_class")}),
binned as (select *, case when feature in ({", ".join(_literal(c) for c in text.STREAKS)}) then v / o else v end b from fields),
moved as (select *, v * (0.95::double + 0.1::double * ({_u(f"'{SEED}'", "child_id", "feature")} / 4294967296.0::double)) m from fields)"""
_WORDED = ", ".join(_literal(c) for c in [*text.RATIOS, *text.STREAKS])
_CV = f"""{FEATURES},
l as (select child_id item_id, {_PLAIN} as label, cast(regexp_extract(child_id, '^u(\\d+):', 1) as bigint) % 10 as "group" from features),
k as (select greatest(2, least(5, min(n))) k from (select count(*) n from l group by label)),
folded as (select 'stratified' scheme, item_id, label, cast((row_number() over (partition by label order by {_u("'42'", 'item_id')}, item_id) - 1) % k as int) fold from l, k
  union all select 'by_group', item_id, label, cast(dense_rank() over (order by "group") - 1 as int) from l),
by_fold as (select scheme, fold, label, count(*) n from folded group by all),
rest as (select f.scheme, f.fold, t.label, t.n - coalesce(b.n, 0) n from (select distinct scheme, fold from folded) f join (select scheme, label, sum(n) n from by_fold group by 1, 2) t using (scheme) left join by_fold b on b.scheme = f.scheme and b.fold = f.fold and b.label = t.label),
best as (select scheme, fold, arg_max(label, (n, label)) predicted from rest group by 1, 2),
out_of_fold as (select scheme, item_id, fold, label, predicted from folded join best using (scheme, fold))"""
_FILES = f"""{FEATURES}, split_frames as (select *, case video_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end split from frames)"""


SQL: dict[str, str] = {
    "rule_labels_kappa": f"with {FEATURES}, labelled as (select 'rule_based' as system, {_PLAIN} truth, {_RULE.format(score='attention_stability_score')} as label, 1.0::double w from features), {_scores('labelled', 'system')} select system, n, {', '.join(_r(m, m) for m in METRIC_NAMES)} from scores",
    "child_frames": f"with {FRAMES} select clip, child_id, person_id, frame, bbox_x, bbox_y, bbox_width, bbox_height, gaze_class, {_r('gaze_x', 'gaze_x')}, {_r('gaze_y', 'gaze_y')}, is_child, fps, channel_id, video_id from frames",
    "seq_class_ratios": _feature_query("observed_frames", "visible_ratio", "on_screen_ratio", "gaze_shift_ratio", "gaze_shift_events", "occlusion_ratio", "eyes_closed_ratio"),
    "seq_head_motion": _feature_query("mean_head_area", "mean_head_motion"),
    "seq_gaze_motion": _feature_query("mean_gaze_motion"),
    "seq_streaks": _feature_query("max_visible_streak", "max_occlusion_streak"),
    "seq_dominant": _feature_query("dominant_gaze_class"),
    "seq_features": _feature_query(*_MODEL, "dominant_gaze_class"),
    "segments": f"with {SEGMENTS} select child_id, segment_index, segment_type, start_frame, end_frame, gaze_class, {_r('avg_gaze_x', 'avg_gaze_x')}, {_r('avg_gaze_y', 'avg_gaze_y')}, frame_count, {_r('start_time', 'start_time')}, {_r('end_time', 'end_time')}, {_r('duration', 'duration')} from segs",
    "interactions": f"with {SEGMENTS} select * from events_of",
    "exploratory_events": f"with {SEGMENTS} select child_id, interaction_index, start_time, end_time, duration, supporting from spanning",
    "payload_counts": f"with {SEGMENTS} select child_id, num_segments, num_interactions from (select child_id, count(*) num_segments from segs group by 1) join (select child_id, count(*) num_interactions from events_of group by 1) using (child_id)",
    "rule_labels": f"with {FEATURES} select child_id, {_RULE.format(score='attention_stability_score')} as label, case when eyes_closed_ratio >= 0.3 then 0.72 when occlusion_ratio >= 0.35 then 0.74 when visible_ratio >= 0.75 and gaze_shift_ratio <= 0.1 and mean_gaze_motion <= 120 and attention_stability_score >= 0.65 then 0.84 when gaze_shift_ratio >= 0.2 or mean_gaze_motion >= 180 then 0.8 else 0.68 end::double as confidence from features",
    "stability_sensitivity": f"""with {FEATURES}, grid(weights, w0, w1, w2, w3) as (values {_WEIGHTS}),
scored as (select *, greatest(0.0::double, least(1.0::double, w0 * visible_ratio + w1 * (max_visible_streak / observed_frames) + w2 * (1.0::double - least(mean_gaze_motion / 300.0::double, 1.0::double)) + w3 * (1.0::double - gaze_shift_ratio))) score from features cross join grid),
labelled as (select child_id, weights, {_RULE.format(score='score')} as label from scored),
joined as (select a.weights, a.label, b.label as truth, 1.0::double w from labelled a join labelled b on a.child_id = b.child_id and b.weights = 'paper'),
{_scores('joined', 'weights')} select weights, n, {_r('accuracy', 'accuracy')}, {_r('kappa', 'kappa')}, (select count(*) from joined j where j.weights = scores.weights and j.label <> j.truth) changed from scores""",
    "reliability_gate": f"with {FEATURES} select child_id, visible_ratio < 0.5 or max_occlusion_streak > 30 or eyes_closed_ratio > 0.3 as gated from features",
    "hybrid_vote_sweep": f"""with {VOTES}, items as (select item_id, consensus as truth, fine_cluster % 11 = 0 gated, p.label rule_label, v0, v1, v2, k from ratings join predictions p using (item_id) join votes using (item_id) where p.system = 'rule_based'),
swept as (select *, a / 10.0::double alpha from items cross join (select unnest(generate_series(0, 10)) a)),
graded as (select *, {', '.join(f'{_alpha_score(k, c)} s{k}' for k, c in enumerate(LABELS))} from swept),
chosen as (select alpha, truth, 1.0::double w, case when gated then 'others' when s0 >= s1 and s0 >= s2 then 'focused' when s1 >= s2 then 'mix' else 'others' end as label from graded),
{_scores('chosen', 'alpha')} select alpha, n, {_r('accuracy', 'accuracy')}, {_r('kappa', 'kappa')}, {_r('macro_f1', 'macro_f1')}, (select alpha from scores order by kappa desc, alpha limit 1) best_alpha from scores""",
    "majority_vote": f"with {PREDICTIONS} select item_id, arg_min(label, (-n, label)) as label from (select item_id, label, count(*) n from predictions where label is not null group by 1, 2) group by 1",
    "agreement_pattern": f"with {PREDICTIONS} select item_id, case when count(distinct label) = 1 then 'all_agree' else 'split_' || count(distinct label) || '_ways' end as pattern from predictions group by 1",
    "annotation_sheet": f"with {PREDICTIONS}, sheet as (select item_id, {', '.join(f"max(label) filter (system = '{s}') s{k}" for k, (s, _) in enumerate(SYSTEMS))}, case when count(distinct label) = 1 then 'all_agree' else 'split_' || count(distinct label) || '_ways' end as pattern from predictions group by 1) select item_id, cluster, consensus suggested_label, {', '.join(f's{k}' for k in range(len(SYSTEMS)))}, pattern, cast(null as varchar) annotator_label, cast(null as varchar) notes from ratings join sheet using (item_id)",
    "integrity_violations": """with clips as (select c_name clip, c_mktsegment split, c_nationkey + c_custkey % 2 video_id, c_custkey from customer),
splits as (select clip, case when c_custkey % 13 = 0 then 'TEST' else split end split from clips where c_custkey % 17 <> 0)
select 'no_split' problem, clip as key from clips where clip not in (select clip from splits)
union all select 'split_differs', clip from clips c join splits s using (clip) where c.split <> s.split
union all select 'no_video', clip from clips where video_id not in (select n_nationkey from nation)""",
    "label_map_5to3": "select event_id, case event_id % 7 when 0 then 'focused' when 1 then 'mix' when 2 then 'mix' when 3 then 'mix' end as three, event_id % 7 = 6 as unknown from events",
    "family_names": f"with {PREDICTIONS} select system, {_FAMILY} family, {_SHORT} short, replace(replace(system || ':v/1', '/', '_'), ':', '__') file, count(label) n from predictions group by system",
    "clip_source_frames": """select event_id, case when user_id % 5 = 0 then '31lG75MDwSA' else 'vid_' || user_id end video_name, cast(case when user_id % 5 = 0 then 2857 else user_id * 100 + 7 end as int) clip_start,
  cast(case when user_id % 5 = 0 then 2928 else user_id * 100 + 87 end as int) clip_end, user_id % 5 <> 0 and user_id % 3 = 0 as downsampled,
  cast(case when user_id % 5 = 0 then 2857 + (event_id % 80 + 1) - 2 else user_id * 100 + 7 + (event_id % 80 + 1) * (case when user_id % 3 = 0 then 2 else 1 end) - 1 end as int) source_frame from events""",
    "forbidden_tokens": """with j as (select o_orderstatus, o_orderpriority, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey)
select 'o_orderstatus' "column", count(*) filter (o_orderstatus ilike '%urg%') hits from j union all select 'o_orderpriority', count(*) filter (o_orderpriority ilike '%urg%') from j
union all select 'c_name', count(*) filter (c_name ilike '%urg%') from j union all select 'c_mktsegment', count(*) filter (c_mktsegment ilike '%urg%') from j""",
    "missing_predictions": f"with {PREDICTIONS} select system, count(*) n_items, count(*) - count(label) n_missing from predictions group by 1",
    "unknown_classes": f"with {FRAMES} select gaze_class, count(*) n from frames0 where gaze_class = 'inside_ambiguous' group by 1",
    "confusion": f"""with {LONG}, keys as (select distinct system, reference, unnest(['focused', 'mix', 'others', 'all']) truth from known),
c as (select system, reference, truth, label from known union all select system, reference, 'all', label from known)
select k.system, k.reference, k.truth, count(*) filter (label = 'focused') focused, count(*) filter (label = 'mix') mix, count(*) filter (label = 'others') others, count(label) total
from keys k left join c using (system, reference, truth) group by 1, 2, 3""",
    "system_metrics": f"with {SCORES} select system, reference, n, {', '.join(_r(m, m) for m in METRIC_NAMES)} from scores",
    "per_class_metrics": f"with {SCORES} " + " union all ".join(f"select system, reference, '{c}' as \"class\", {_r(f'p{k}', 'precision')}, {_r(f'r{k}', 'recall')}, {_r(f'f{k}', 'f1')}, cast(t{k} as bigint) support from scores" for k, c in enumerate(LABELS)),
    "rater_kappa": f"with {WIDE} select system, {', '.join(_r(c, c) for c in ('rater1', 'rater2', 'consensus'))} from wide_",
    "varied_systems": f"with {WIDE} select system, {', '.join(_r(c, c) for c in ('rater1', 'rater2', 'consensus'))} from wide_ where abs(rater1) > 1e-6 or abs(rater2) > 1e-6",
    "delta_kappa": f"with {WIDE} select system, {_FAMILY} family, {_r('rater1', 'kappa_rater1')}, {_r('rater2', 'kappa_rater2')}, {_r('rater1 - rater2', 'delta')}, varied from wide_",
    "family_contrast": f"with {WIDE} select {_r(f"avg(rater1 - rater2) filter (varied and {_FAMILY} = 'llm') - avg(rater1 - rater2) filter (varied and {_FAMILY} in ('rule', 'supervised'))", 'contrast')} from wide_",
    "disagreement_zone": f"with {PREDICTIONS} select item_id, rater1, rater2, count(*) filter (label = rater1) sided_rater1, count(*) filter (label = rater2) sided_rater2, count(*) filter (label not in (rater1, rater2)) third from predictions join ratings using (item_id) where rater1 <> rater2 and label is not null group by 1, 2, 3",
    "sided_by_family": f"with {PREDICTIONS}, z as (select {_FAMILY} family, label, rater1, rater2 from predictions join ratings using (item_id) where rater1 <> rater2 and label is not null) select coalesce(family, 'total') family, count(*) filter (label = rater1) sided_rater1, count(*) filter (label = rater2) sided_rater2, count(*) n from z group by rollup (family)",
    "item_difficulty": f"with {CONSENSUS} select item_id, count(*) filter (label = truth) n_correct, count(label) n_systems from rows_ group by 1",
    "label_resolution": f"with {RATINGS} select rater1 = rater2 raters_agree, case when consensus = rater1 and consensus = rater2 then 'both' when consensus = rater1 then 'rater1' when consensus = rater2 then 'rater2' else 'neither' end consensus_matches, count(*) n from ratings group by 1, 2",
    "label_distribution": f"with {RATINGS} " + " union all ".join(f"select '{r}' rater, '{c}' as label, count(*) filter ({r} = '{c}') n from ratings" for r in ("rater1", "rater2", "consensus") for c in LABELS),
    "class_pairs": f"with {RATINGS} select least(rater1, rater2) || ' / ' || greatest(rater1, rater2) as pair, count(*) n from ratings where rater1 <> rater2 group by 1",
    "condition_flips": f"with {PREDICTIONS} select 'llm' as system, a.system as condition, count(*) n, {_r('avg(case when a.label <> b.label then 1.0 else 0.0 end)', 'flip_rate')}, count(*) filter (a.label = b.label) same from predictions a join predictions b using (item_id) where a.system like 'llm%' and a.system <> b.system and b.system = '{SYSTEMS[1][0]}' group by 2",
    "mcnemar_pairs": f"with {MCNEMAR} select system_a, system_b, b, c, {_r('p', 'p')} from tests",
    "holm_adjusted": f"with {MCNEMAR}, ranked as (select system_a, system_b, (count(*) over () - row_number() over o + 1) * round(p, 9) adj, row_number() over o r from tests window o as (order by round(p, 9), system_a, system_b)) select system_a, system_b, {_r('least(1.0::double, max(adj) over (order by r))', 'p_holm')} from ranked",
    "calibration": f"""with {CONSENSUS}, k as (select system, confidence, label = truth ok, ceil(confidence * 100 / 10 - 1e-9) bin from rows_ where label is not null),
e as (select system, sum(abs(d)) / sum(n) ece from (select system, bin, count(*) n, sum(ok::int) - sum(confidence) d from k group by 1, 2) group by 1),
s as (select system, confidence, count(*) filter (ok) a, count(*) filter (not ok) b from k group by 1, 2),
roc as (select system, sum(won) / (sum(a) * sum(b)) auroc from (select system, a, b, a * (coalesce(sum(b) over (partition by system order by confidence rows between unbounded preceding and 1 preceding), 0) + b / 2.0) won from s) group by 1)
select k.system, count(*) n, {_r('avg(ok::int)', 'accuracy')}, {_r('avg(confidence)', 'conf_mean')}, {_r('avg(confidence) filter (ok)', 'conf_correct')}, {_r('avg(confidence) filter (not ok)', 'conf_wrong')}, {_r('any_value(auroc)', 'auroc')}, count(distinct confidence) distinct_conf, {_r('any_value(ece)', 'ece')} from k join e using (system) join roc using (system) group by 1""",
    "boot_cluster_ci": f"with {BOOT} select system, reference, {_ci('accuracy')}, {_ci('kappa')} from scores group by 1, 2",
    "boot_paired_diff": f"with {BOOT}, d as (select a.system, reference, a.accuracy - b.accuracy diff from scores a join scores b using (rep, reference) where b.system = 'rule_based' and a.system <> 'rule_based') select system, reference, {_ci('diff')}, quantile_cont(diff, 0.025) > 0 or quantile_cont(diff, 0.975) < 0 excludes_zero from d group by 1, 2",
    "boot_item_ci": f"""with {CONSENSUS}, {_resampled("rows_ where label is not null", ["system"], SEED)},
{_scores('weighed', 'rep, system')} select system, {", ".join(f"{_r(f'avg({m})', f'{m}_mean')}, {_ci(m)}" for m in ("accuracy", "kappa", "macro_f1"))} from scores group by 1""",
    "boot_kappa_multinomial": f"""with {LONG}, {_resampled("known", ["system", "reference"], 42)},
{_scores('weighed', 'rep, system, reference')}, single as (select system, reference, rep, count(distinct truth) < 2 or count(distinct label) < 2 skip_ from weighed where w > 0 group by 1, 2, 3),
kept as (select system, reference, case when not skip_ then kappa end kappa, skip_ from scores join single using (system, reference, rep)) select system, reference, {_ci('kappa')}, count(*) filter (skip_) skipped from kept group by 1, 2""",
    "perm_null": f"""with {LONG}, {_shuffled()},
seen as (select system, k1 - k2 observed from (select system, {_kappa_of("rater1", "label")} k1, {_kappa_of("rater2", "label")} k2 from (select system, rater1, rater2, label from predictions join ratings using (item_id) where label is not null) group by 1)),
known_ as (select system, any_value(observed) observed, avg(delta) null_mean, quantile_cont(delta, 0.025) lo, quantile_cont(delta, 0.975) hi, count(*) filter (delta is null) undefined_ from null_ join seen using (system) group by 1)
select system, {_r('any_value(observed)', 'observed')}, {_r('any_value(null_mean)', 'null_mean')}, {_r('any_value(lo)', 'delta_lo')}, {_r('any_value(hi)', 'delta_hi')}, any_value(undefined_) delta_undefined,
  {_r('avg(case when abs(delta - null_mean) >= abs(observed - null_mean) - 1e-12 then 1.0::double else 0.0::double end)', 'p')} from null_ join known_ using (system) group by 1""",
    "perm_null_rank": f"""with {PREDICTIONS}, reps as (select unnest(generate_series(0, {SHUFFLES - 1})) rep), p as (select * from predictions cross join reps where system in ('rule_based', 'supervised_RandomForest')),
ranked as (select *, row_number() over (partition by system, rep order by {_u("'place'", 'item_id')}, item_id) place, row_number() over (partition by system, rep order by {_u(f"'{SEED}'", 'system', 'rep', 'item_id')}, item_id) moved from p),
mixed as (select a.system, a.rep, a.item_id, b.label from ranked a join ranked b on a.system = b.system and a.rep = b.rep and a.moved = b.place),
both_ as (select m.system, rep, 'rater1' as reference, label, rater1 truth, 1.0::double w from mixed m join ratings using (item_id) union all select m.system, rep, 'rater2', label, rater2, 1.0 from mixed m join ratings using (item_id)),
{_scores('both_', 'system, rep, reference')} select system, cast(rep as int) rep, {_r("max(kappa) filter (reference = 'rater1') - max(kappa) filter (reference = 'rater2')", 'delta')} from scores group by 1, 2""",
    "payload_from_prompt": f"with {FEATURES}, {SEGMENTS.removeprefix(FRAMES + ',')} select child_id, {_r('visible_ratio', 'visible_ratio')}, {_r('occlusion_ratio', 'occlusion_ratio')}, {_r('mean_gaze_motion', 'mean_gaze_motion')}, num_segments, max_visible_streak from features join (select child_id, count(*) num_segments from segs group by 1) using (child_id)",
    "prompt_conditions": f"""with {FEATURES}, base as (select child_id, dominant_gaze_class, visible_ratio, mean_gaze_motion, observed_frames, {_u(f"'{SEED}'", 'child_id', "'observed_frames'")} / 4294967296.0::double u from features)
select child_id, 'C0' as condition, false guided, cast(observed_frames as double) observed_frames, dominant_gaze_class dominant, cast(null as varchar) visible_word, cast(null as varchar) motion_word from base
union all select child_id, 'C1', true, observed_frames, dominant_gaze_class, null, null from base
union all select child_id, 'C2', false, observed_frames, dominant_gaze_class, case when visible_ratio < 1 / 3 then 'low' when visible_ratio < 2 / 3 then 'medium' else 'high' end, case when mean_gaze_motion < 100 then 'low' when mean_gaze_motion < 200 then 'medium' else 'high' end from base
union all select child_id, 'C3', false, observed_frames, null, null, null from base
union all select child_id, 'C4', false, round_even(observed_frames * (0.95::double + 0.1::double * u), 0), dominant_gaze_class, null, null from base""",
    "nli_premises": f"with {FEATURES} select child_id, max_visible_streak streak_p1, observed_frames frames_p2, round(visible_ratio, 3) visible_p1 from features",
    "nli_entailment": f"""with {FRAMES}, combos(label_set, template) as (values ('L1 bare names', 'T1 paper'), ('L1 bare names', 'T2 attention'), ('L2 short phrases', 'T1 paper'), ('L2 short phrases', 'T2 attention'), ('L3 full definitions', 'T3 definition')),
g as (select child_id, label_set, template, label, ({_u('child_id', 'label_set', 'template', 'label')} % 1000) / 100.0::double + length(label) / 1000.0::double logit from (select distinct child_id from frames) cross join combos cross join (select unnest(['focused', 'mix', 'others']) as label))
select child_id, label_set, template, arg_max(label, logit) as label, {_r('1 / sum(exp(logit - top))', 'confidence')} from (select *, max(logit) over (partition by child_id, label_set, template) top from g) group by 1, 2, 3""",
    "fewshot_examples": f"with {FEWSHOT} select item_id, place, example_id, label from chosen",
    "parse_generations": f"with {GENERATIONS} select system, item_id, label, confidence, status from parsed",
    "cv_bundle": f"""with {FEATURES} select 'predictions' as name, 2 * count(*) as "rows" from features union all select * from (values ('summary', 2), ('confusion', 8), ('reports', 6))""",
    "raw_repro": f"""with {GENERATIONS}, twice as (select system, raw a, case item_id % 3 when 0 then raw || ' END' when 1 then ' ' || raw else reverse(raw) end b from (select *, {_RAW} as raw from parsed)),
bare as (select system, trim(a, chr(9) || chr(10) || chr(13) || ' ') a, trim(b, chr(9) || chr(10) || chr(13) || ' ') b from twice)
select system, count(*) n, count(*) filter (a = b) identical, count(*) filter (starts_with(b, a)) prefixes, min(length(b) - length(a)) filter (starts_with(b, a) and a <> b) extra_min,
  median(length(b) - length(a)) filter (starts_with(b, a) and a <> b) extra_median, max(length(b) - length(a)) filter (starts_with(b, a) and a <> b) extra_max from bare group by 1""",
    "parse_status": f"with {GENERATIONS} select system, status, count(*) n from parsed group by 1, 2",
    "vote_texts": f"with {VOTES} select item_id, (select string_agg(l || ' ' || v, ', ' order by v desc, o) from (values ('focused', v0, 0), ('mix', v1, 1), ('others', v2, 2)) t(l, v, o) where v > 0) votes from votes",
    "pending_items": f"with {PREDICTIONS} select system, item_id from predictions where not (label is not null and item_id % 4 <> 0)",
    "dead_letters": f"with {GENERATIONS} select system, item_id, 'mix' as label, 0.0::double confidence, 'error:no_json' reasoning from parsed where status = 'no_json'",
    "condition_metrics": f"with {CONDITIONS} select system, condition, n, no_json, invalid, n_focused, n_mix, n_others, {', '.join(_r(c, c) for c in ('agree_with_rule', 'accuracy', 'f1_others', 'kappa_rater1', 'kappa_rater2', 'kappa_consensus'))} from cond_metrics",
    "condition_kappa": f"with {CONDITIONS}, k as (select system, max(kappa_consensus) filter (condition = 'C0') c0, max(kappa_consensus) filter (condition = 'C1') c1, max(kappa_consensus) filter (condition = 'C2') c2 from cond_metrics group by 1) select system, {_r('c0', 'C0')}, {_r('c1', 'C1')}, {_r('c2', 'C2')}, {_r('c1 - c0', 'change_C1')}, {_r('c2 - c0', 'change_C2')} from k",
    "fewshot_table": f"with {CONDITIONS}, k as (select system, max(kappa_consensus) filter (condition = 'C0') a, avg(kappa_consensus) filter (condition <> 'C0') b, sum(n_others) filter (condition <> 'C0') po, sum(no_json + invalid) filter (condition <> 'C0') un from cond_metrics group by 1) select system, {_r('a', 'kappa_base')}, {_r('b', 'kappa_mean')}, cast(po as bigint) predicted_others, cast(un as bigint) unparsed, {_r('b - a', 'delta')} from k",
    "others_locator": f"with {CONDITIONS} select condition, system, item_id, consensus, rule_label from cond join ratings using (item_id) join rule_ using (item_id) where label = 'others'",
    "gate_audit": f"with {ITEMS} select count(*) filter (gated) flagged, count(*) filter (gated and rule_label = truth) rule_right, count(*) filter (gated and truth = 'others') truly_others from items",
    "case_studies": f"with {ITEMS} select item_id, truth, gated, rule_label, v0 votes_focused, v1 votes_mix, v2 votes_others from items where truth = 'others' or gated",
    "feature_medians": f"with {FEATURES} select {_RULE.format(score='attention_stability_score')} rule_label, count(*) n, {', '.join(_r(f'median({c})', c) for c in ('visible_ratio', 'gaze_shift_ratio', 'occlusion_ratio', 'mean_gaze_motion', 'attention_stability_score'))} from features group by 1",
    "first_items": f"with {RATINGS} select item_id, consensus from ratings order by item_id limit 100",
    "score_consistency": f"""with {FRAMES} select count(distinct child_id) n, count(distinct child_id) filter ({_u("'stored'", "child_id")} % 13 = 0) n_wrong from frames""",
    "file_discovery": f"with {PREDICTIONS} select system, cast(item_id as varchar) item_id, label, case when system <> 'rule_based' then round(confidence, 6) + 0.0::double end as confidence from predictions where label is not null",
    "cv_folds": f"with {FEATURES}, l as (select child_id item_id, {_PLAIN} as label from features), k as (select greatest(2, least(5, min(n))) k from (select count(*) n from l group by label)) select item_id, label, cast((row_number() over (partition by label order by {_u("'42'", 'item_id')}, item_id) - 1) % k as int) fold from l, k",
    "dummy_stratified": f"with {FEATURES}, l as (select child_id item_id, {_PLAIN} as label, {_u("'42'", 'child_id')} / 4294967296.0::double u from features), s as (select label as p, sum(count(*)) over (order by label) / sum(count(*)) over ()::double hi from l group by label) select item_id, min(p) predicted from l join s on hi > u group by 1",
    "boot_video_ci": f"with {BOOT_VIDEO} select system, reference, {_ci('accuracy')}, {_ci('kappa')} from scores group by 1, 2",
    "boot_delta_kappa": f"with {DELTAS} select system, {_ci('delta')} from deltas group by 1",
    "boot_family_contrast": f"""with {DELTAS}, varied as (select system, {_FAMILY} family, max(n) / sum(n) < 0.95 varied from (select system, label, count(*) n from predictions where label is not null group by 1, 2) group by 1),
c as (select rep, avg(delta) filter (varied and family = 'llm') - avg(delta) filter (varied and family in ('rule', 'supervised')) contrast from deltas join varied using (system) group by 1) select {_ci('contrast')} from c""",
    "boot_condition_diff": f"""with {_boot()}, cond_0 as (select *, {_u("condition", "system", "item_id")} u2 from (select *, unnest(['C0', 'C1', 'C2']) condition from predictions where system like 'llm%')),
{_replicates("select system, condition, unit, consensus truth, case when condition <> 'C0' and u2 % 10 < 2 then 'mix' else label end as label from cond_0 join units using (item_id)", 'system, condition')},
d as (select a.system, a.condition, a.kappa - b.kappa diff from scores a join scores b using (rep, system) where b.condition = 'C0' and a.condition <> 'C0') select system, condition, {_ci('diff')} from d group by 1, 2""",
    "boot_lacking_class": f"""with {RATINGS}, few as (select consensus, fine_cluster % 21 as unit from ratings where fine_cluster % 97 = 0), names as (select list_sort(list(distinct unit)) names from few), reps as (select unnest(generate_series(0, {REPLICATES - 1})) rep),
draws as (select rep, unnest(generate_series(1, len(names))) draw, names from reps, names), picked as (select rep, names[cast({_u(f"'{SEED}'", "rep", "draw")} % len(names) + 1 as int)] as unit from draws),
got as (select rep, consensus, count(*) n from picked join few using (unit) group by 1, 2), every as (select rep, label from (select distinct rep from picked) cross join (select unnest(['focused', 'mix', 'others']) as label))
select label, count(*) filter (n is null) n_lacking from every left join got on got.rep = every.rep and consensus = label group by 1""",
    "prompt_payloads": f"""with {_PAYLOADS}
select child_id, condition, feature, {_r('v', 'number')}, cast(null as varchar) word from fields cross join (select unnest(['C0', 'C1', 'C3']) condition)
union all select child_id, 'C2', feature, case when feature in ({_WORDED}) or feature = 'mean_gaze_motion' then null else round(v, 6) + 0.0 end, case when feature in ({_WORDED}) then case when b < 1 / 3 then 'low' when b < 2 / 3 then 'medium' else 'high' end
  when feature = 'mean_gaze_motion' then case when v < 100 then 'low' when v < 200 then 'medium' else 'high' end end from binned
union all select child_id, 'C4', feature, round(case when feature in ({', '.join(_literal(c) for c in text.RATIOS)}) then greatest(0.0::double, least(1.0::double, m)) when feature in ({', '.join(_literal(c) for c in text.COUNTS)}) then round_even(m, 0) else m end, 6) + 0.0, null from moved
union all select child_id, condition, 'dominant_gaze_class', null, dominant_gaze_class from payload cross join (select unnest(['C0', 'C1', 'C2', 'C4']) condition)""",
    "nli_premise_texts": f"""with {FEATURES}, s as (select child_id, max_visible_streak m, observed_frames o, round(mean_gaze_motion) g, {', '.join(f'round({c}, 2) {n}' for c, n in (('visible_ratio', 'v'), ('gaze_shift_ratio', 'h'), ('occlusion_ratio', 'k'), ('eyes_closed_ratio', 'e'), ('attention_stability_score', 'a')))} from features)
select child_id, printf('Child gaze behavior summary. visible_ratio=%.3f, gaze_shift_ratio=%.3f, occlusion_ratio=%.3f, eyes_closed_ratio=%.3f, mean_gaze_motion=%.2f, attention_stability_score=%.3f, max_visible_streak=%d.', v, h, k, e, g, a, m) p1,
printf('In this clip, the child''s gaze is visible in %.0f%% of the frames, shifts between targets in %.0f%% of the frames, is occluded or uncertain in %.0f%% of the frames, and the eyes are closed in %.0f%% of the frames. The longest uninterrupted visible stretch lasts %d of %d frames. The gaze point moves on average %.0f pixels between frames, and the attention stability score is %.2f out of 1.', 100.0::double * v, 100.0::double * h, 100.0::double * k, 100.0::double * e, m, o, g, a) p2 from s""",
    "nli_hypotheses": f"with {FEATURES} select label_set, template, label, hypothesis, (select count(*) from features) n_premises from (values {', '.join('(' + ', '.join(_literal(x) for x in (s_, t_, c_, text.TEMPLATES[t_].replace('{}', text.LABEL_SETS[s_][c_]))) + ')' for s_, t_ in text.COMBINATIONS for c_ in LABELS)}) h(label_set, template, label, hypothesis)",
    "fewshot_prompts": f"""with {FEWSHOT}, told as (select item_id, string_agg('Example ' || place || ':\nFeatures:\n' || '{{"item": ' || example_id || '}}' || '\nCategory: ' || label || '\n\n', '' order by place) shown, string_agg(label, ',' order by place) labels from chosen group by 1)
select item_id, md5('Task.\n' || {_literal(text.FEWSHOT_INTRO)} || shown || {_literal(text.FEWSHOT_OUTRO)} || {_literal(text.ANCHOR)} || '\nFeatures:\n' || '{{"item": ' || item_id || '}}') digest, labels from told""",
    "parse_legacy": f"""with {GENERATIONS} select system, item_id, case when kind in (4, 8, 9) then 'unsure' when kind not in (3, 5, 10, 13, 15) then {_OLD} end as label, case when kind <> 3 then confidence end as confidence,
  case when kind = 3 then 'no_json' else status end as status, case when kind = 0 then 'seen' when kind in (1, 2, 6, 7) then 'seen in the clip' when kind in (4, 8, 9, 11, 12, 14) then '' end reasoning from parsed""",
    "legacy_prompts": f"with {FEATURES} select child_id, md5({_literal(text.LEGACY_INTRO)}) digest, observed_frames, dominant_gaze_class dominant from features",
    "scored_prompts": f"with {RATINGS} select item_id, case when item_id % 10 <> 7 then md5('Item ' || item_id) end as raw, case when item_id % 10 = 7 then 'ValueError' end as error from ratings",
    "vote_parses": f"with {VOTES} select item_id, cast(v0 as int) votes_focused, cast(v1 as int) votes_mix, cast(v2 as int) votes_others from votes",
    "duplicate_frames": f"with {FRAMES} select child_id, frame // 2 as frame, count(*) n from frames0 group by 1, 2 having count(*) > 1",
    "hybrid_vote_raters": f"""with {ITEMS_K}, swept as (select *, a / 10.0::double alpha from items cross join (select unnest(generate_series(0, 10)) a)),
graded as (select *, {', '.join(f'{_alpha_score(k, c)} s{k}' for k, c in enumerate(LABELS))} from swept),
chosen as (select alpha, item_id, case when gated then 'others' when s0 >= s1 and s0 >= s2 then 'focused' when s1 >= s2 then 'mix' else 'others' end as label from graded),
rows_ as ({" union all ".join(f"select alpha, '{r}' as reference, {r} truth, label, 1.0::double w from chosen join ratings using (item_id)" for r in ('rater1', 'rater2', 'consensus'))}),
{_scores('rows_', 'alpha, reference')} select alpha, reference, n, {_r('accuracy', 'accuracy')}, {_r('kappa', 'kappa')} from scores""",
    "hybrid_vote_report": f"""with {ITEMS_K}, swept as (select *, a / 10.0::double alpha from items cross join (select unnest(generate_series(0, 10)) a)),
graded as (select *, {', '.join(f'{_alpha_score(k, c)} s{k}' for k, c in enumerate(LABELS))} from swept),
chosen as (select alpha, truth, 1.0::double w, case when gated then 'others' when s0 >= s1 and s0 >= s2 then 'focused' when s1 >= s2 then 'mix' else 'others' end as label from graded),
{_scores('chosen', 'alpha')}, best as (select * from scores order by kappa desc, alpha limit 1) """ + " union all ".join(f"select alpha, '{c}' as \"class\", {_r(f'p{k}', 'precision')}, {_r(f'r{k}', 'recall')}, {_r(f'f{k}', 'f1')}, cast(t{k} as bigint) support from best" for k, c in enumerate(LABELS)),
    "difficulty_table": f"with {CONSENSUS}, c as (select item_id, count(*) filter (label = truth) n_correct, count(label) n_systems, {', '.join(f"max(label) filter (system = '{s_}') s{k}" for k, (s_, _) in enumerate(SYSTEMS))} from rows_ group by 1) select *, row_number() over (order by n_correct, item_id) place from c",
    "sided_by_varied_family": f"with {PREDICTIONS}, varied as (select system from (select system, label, count(*) n from predictions where label is not null group by 1, 2) group by 1 having max(n) / sum(n) < 0.95), z as (select {_FAMILY} family, label, rater1, rater2 from predictions join ratings using (item_id) where rater1 <> rater2 and label is not null and system in (select system from varied)) select coalesce(family, 'total') family, count(*) filter (label = rater1) sided_rater1, count(*) filter (label = rater2) sided_rater2, count(*) n from z group by rollup (family)",
    "group_folds": f"with {_CV} select item_id, \"group\", fold from folded join l using (item_id) where scheme = 'by_group'",
    "dummy_majority": f"with {_CV} select item_id, (select arg_max(label, (n, label)) from (select label, count(*) n from l group by 1)) predicted from l",
    "dummy_out_of_fold": f"with {_CV} select scheme, item_id, fold, predicted from out_of_fold",
    "cv_summary": f"""with {_CV}, rows_ as (select fold, label as truth, predicted as label, 1.0::double w from out_of_fold where scheme = 'stratified'), {_scores('rows_', 'fold')}, pooled_rows as (select 1 one, truth, label, w from rows_), {_scores('pooled_rows', 'one', 'pooled')}
select count(*) folds, {', '.join(f"{_r(f'avg({m})', m + '_mean')}, {_r(f'stddev_pop({m})', m + '_std')}, (select round({m}, 6) + 0.0::double from pooled) {m}_pooled" for m in ('accuracy', 'kappa', 'macro_f1_union'))} from scores""",
    "file_frames": f"with {_FILES} select child_id, frame, gaze_class, {_r('gaze_x', 'gaze_x')}, {_r('gaze_y', 'gaze_y')}, bbox_width, is_child, split, video_id, channel_id, fps from split_frames where split = 'test'",
    "file_features": f"with {_FILES} select child_id, (['focused', 'mix', 'others'])[cast({_u("'given'", 'child_id')} % 3 + 1 as int)] as label, observed_frames, {', '.join(_r(c, c) for c in ('visible_ratio', 'mean_gaze_motion', 'attention_stability_score'))}, (select count(distinct child_id) from frames0 where is_child = 0) n_missing from features",
    "file_predictions": f"with {PREDICTIONS} select system, cast(item_id as varchar) item_id, label, case when system <> 'rule_based' then {'round(confidence, 6) + 0.0::double'} end as confidence, case when system <> 'rule_based' then 'said \"so\", twice' end as reasoning from predictions where label is not null and system in ({', '.join(_literal(s_) for s_, _ in SYSTEMS[:4])})",
}
