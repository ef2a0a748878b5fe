"""SQL for the queries that SQL can express at reasonable cost."""

from __future__ import annotations

from jointmill.plans.sql import BOARD, CROP, NUMBER, joint_class, plain, split_name

P1_FOUND = """
with ok as (
  select distinct run_id, label, pred, crop_id, score, scored_at from predictions
  where score is not null and not isnan(score) and pred between 0 and 3 and crop_id is not null),
last as (
  select * from ok qualify row_number() over (
    partition by run_id, crop_id order by scored_at desc nulls last, label desc, pred desc, score desc) = 1)
select run_id, label, pred, crop_id from last
qualify row_number() over (
  partition by run_id, label, pred order by case when pred = 0 then score else -score end, crop_id) <= 3
"""

_PHOTOS = f"""
photos as (select distinct photo_id, {plain('dataset_path')} as path, {BOARD} as board, package, viewpoint,
  lower(image_name) as name, nullif(trim(group_id), '') as group_id, {NUMBER} as number,
  regexp_replace(lower(trim(fingerprint)), '^0x', '') as print from photo_groups)"""

P2_FOUND = f"""
with e as (select distinct seed, choice_index,
    {plain("substr(crop_id, 1, length(crop_id) - length(split_part(crop_id, '#', -1)) - 1)")} || '#' || trim(split_part(crop_id, '#', -1)) as crop_id,
    {split_name('split')} as split from assignments)
select distinct c.seed, c.choice_index, was.crop_id from (select distinct seed, choice_index from choices) c
join e was on was.seed = c.seed and was.choice_index = c.choice_index - 1 and was.split in ('val', 'test')
left join e now on now.seed = c.seed and now.choice_index = c.choice_index and now.crop_id = was.crop_id
where now.split is distinct from was.split and was.crop_id in (select {CROP} from crops)
"""

_ROUND = "xor({l}, ('0x' || substr(md5('{t}:' || seed::varchar || ':' || ({r})::varchar), 1, 15))::bigint)"


def _network(rows: str) -> str:
    """CTEs n0 .. n4 of a Feistel network over the rows (seed, crop_id, ...), with the number's halves in l and r."""
    out = [f"n0 as (select *, ('0x' || substr(md5(crop_id), 1, 15))::bigint as l, ('0x' || substr(md5(crop_id), 16, 15))::bigint as r from {rows})"]
    for t in range(4):
        turned = _ROUND.format(l="l", r="r", t=t)
        out.append(f"n{t + 1} as (select * exclude (l, r), r as l, {turned} as r from n{t})")
    return ", ".join(out)


_SEEDED = f"""
ids as (select {CROP} as crop_id, min({BOARD}) as board, min(ingested_at) as since from crops group by 1 having {CROP} is not null),
seeds as (select distinct seed, unnest(boards) as board from choices),
pool as (select seed, crop_id, since from ids join seeds using (board))"""
#: 0.2 × 2**120 in halves of 60 bits.
_UNDER = divmod(int(0.2 * (1 << 120)), 1 << 60)
_TAKEN = f"(l < {_UNDER[0]} or (l = {_UNDER[0]} and r < {_UNDER[1]}))"

P2_SAMPLE = f"with {_SEEDED}, {_network('pool')} select seed, crop_id from n4 where {_TAKEN}"

P2_GROWTH = f"""
with {_SEEDED}, {_network('pool')}, v as (select seed, choice_index, min(frozen_at) as frozen_at from choices group by 1, 2),
k as (select v.seed, choice_index, crop_id, {_TAKEN} as taken from n4 join v on v.seed = n4.seed and since <= frozen_at),
lost as (select was.seed, was.choice_index + 1 as choice_index, count(*) as lost from k was join v on v.seed = was.seed and v.choice_index = was.choice_index + 1
  left join k now on now.seed = was.seed and now.choice_index = was.choice_index + 1 and now.crop_id = was.crop_id where was.taken and now.taken is distinct from true group by 1, 2)
select seed, choice_index, count(*) as crops, sum(taken::int)::bigint as drawn, coalesce(any_value(lost), 0) as lost from k left join lost using (seed, choice_index) group by 1, 2
"""

_REACH = f"""
{_PHOTOS},
members as (select list_sort(list_distinct(list_transform(m, lambda x: {plain('x')}))) as m from (select unnest(member_groups) as m from tag_pairs)),
keys as (
  select photo_id, 'g' || group_id as k from photos where group_id is not null
  union select photo_id, 'p' || board || '|' || package || '|' || viewpoint || '|' || name from photos
  union select photo_id, 'n' || board || '|' || package || '|' || number from photos where number is not null
  union select photo_id, 't' || m::varchar from photos join (select m, unnest(m) as path from members) using (path)),
hop as (select distinct a.photo_id as a, b.photo_id as b from keys a join keys b using (k)),
reach(a, b) as (select a, b from hop union select r.a, h.b from reach r join hop h on r.b = h.a)"""

P3_FOUND = f"""
with recursive {_REACH}
select distinct x.group_id as group_id_a, y.group_id as group_id_b from reach
join photos x on x.photo_id = a join photos y on y.photo_id = b where x.group_id < y.group_id
"""

_NAMED = f"{_REACH}, named as (select a as photo_id, min(path) as component from reach join photos on photos.photo_id = b group by 1)"

P3_GROUPS = f"with recursive {_NAMED} select distinct group_id, component from photos join named using (photo_id) where group_id is not null"

P3_SPLIT = f"""
with recursive {_NAMED}, placed as (select path, min(component) as component from photos join named using (photo_id) group by 1),
c as (select {plain('dataset_path')} as path, trim(polygon_rank_x) as rank, min({joint_class('class_name')}) as class_name, min(group_id) as group_id from crops group by 1, 2),
r as (select path || '#' || rank as crop_id, group_id, class_name, coalesce(component, path) as component from c left join placed using (path)),
sizes as (select component, class_name, count(*) as n from r group by 1, 2),
hashed as (select component, ('0x' || substr(md5('0:' || component), 1, 13))::bigint as h, ('0x' || substr(md5('0:' || component), 14, 13))::bigint as step from (select distinct component from r)),
u as (select component, s, ((h + step * s) % 4503599627370496)::double / 4503599627370496 as u from hashed cross join range(32) t(s)),
dealt as (select component, s, case when u < 0.6 then 'train' when u < 0.8 then 'val' else 'test' end as split from u),
n as (select s, class_name, sum(n) filter (where split = 'train') as a, sum(n) filter (where split = 'val') as b, sum(n) filter (where split = 'test') as c from sizes join dealt using (component) group by 1, 2),
d as (select s, coalesce(a, 0)::double as a, coalesce(b, 0)::double as b, coalesce(c, 0)::double as c from n),
o as (select s, sum(abs(a / (a + b + c) - 0.6) + abs(b / (a + b + c) - 0.2) + abs(c / (a + b + c) - 0.2)) as off, sum(a) as a, sum(b) as b, sum(c) as c from d group by 1),
best as (select s from o order by round(off + abs(a / (a + b + c) - 0.6) + abs(b / (a + b + c) - 0.2) + abs(c / (a + b + c) - 0.2), 9), s limit 1)
select crop_id, group_id, class_name, component, split from r join dealt using (component) join best using (s)
"""

P4_FOUND = f"""
with {_PHOTOS},
sides as (select distinct photo_id, photos.board, package, group_id, number, name, case when regexp_matches(print, '^[0-9a-f]{{64}}$') and not regexp_matches(print, '^0+$') then print end as print, split = 'train' as train
  from photos join (select distinct {plain('dataset_path')} as path, {split_name('split')} as split from crops) s using (path) where split is not null),
words as (select *, list_transform(range(8), lambda i: ('0x' || substr(print, i * 8 + 1, 8))::bigint) as w from sides)
select distinct least(t.photo_id, e.photo_id) as photo_id_a, greatest(t.photo_id, e.photo_id) as photo_id_b
from words t join words e on t.board = e.board and t.package = e.package and t.train and not e.train and t.photo_id <> e.photo_id
where t.group_id = e.group_id or t.number = e.number or t.name = e.name
  or bit_count(xor(t.w[1], e.w[1]))::int + bit_count(xor(t.w[2], e.w[2]))::int + bit_count(xor(t.w[3], e.w[3]))::int + bit_count(xor(t.w[4], e.w[4]))::int
   + bit_count(xor(t.w[5], e.w[5]))::int + bit_count(xor(t.w[6], e.w[6]))::int + bit_count(xor(t.w[7], e.w[7]))::int + bit_count(xor(t.w[8], e.w[8]))::int <= 10
"""

_BITS = " + ".join(f"bit_count(xor(t.w[{i}], e.w[{i}]))::int" for i in range(1, 9))
_CANONICAL = "trim(regexp_replace(lower({c}), '[[:punct:]\\s\\x0B]+', ' ', 'g'))"

P4_REPORT = f"""
with {_PHOTOS},
sides as (select distinct photo_id, photos.board, package, group_id, number, nullif(name, '') as name, split,
    case when regexp_matches(print, '^[0-9a-f]{{64}}$') and not regexp_matches(print, '^0+$') then print end as print
  from photos join (select distinct {plain('dataset_path')} as path, {split_name('split')} as split from crops) s using (path) where split is not null and package is not null and photos.board is not null),
words as (select *, {_CANONICAL.format(c='group_id')} as g, {_CANONICAL.format(c='name')} as m, list_transform(range(8), lambda i: ('0x' || substr(print, i * 8 + 1, 8))::bigint) as w from sides),
pairs as (select e.photo_id as e, t.photo_id as t, e.split, e.board, coalesce(t.group_id = e.group_id, false) as same_group, coalesce(t.number = e.number, false) as same_number, coalesce(t.name = e.name, false) as same_name,
    coalesce({_BITS} <= 10, false) as near_print, coalesce(t.g = e.g and t.g <> '' and t.group_id <> e.group_id, false) as alike_group, coalesce(t.m = e.m and t.m <> '' and t.name <> e.name, false) as alike_name
  from words t join words e on t.board = e.board and t.package = e.package and t.split = 'train' and e.split <> 'train' and t.photo_id <> e.photo_id),
one as (select e, t, split, board, bool_or(same_group) as same_group, bool_or(same_number) as same_number, bool_or(same_name) as same_name, bool_or(near_print) as near_print,
    bool_or(alike_group) and not bool_or(same_group) as alike_group, bool_or(alike_name) and not bool_or(same_name) as alike_name
  from pairs where same_group or same_number or same_name or near_print or alike_group or alike_name group by 1, 2, 3, 4)
select split, board, count(distinct e) as photos, count(*) as pairs, sum(same_group::int)::bigint as pairs_same_group, sum(same_number::int)::bigint as pairs_same_number, sum(same_name::int)::bigint as pairs_same_name,
  sum(near_print::int)::bigint as pairs_near_print, sum(alike_group::int)::bigint as pairs_alike_group, sum(alike_name::int)::bigint as pairs_alike_name from one group by 1, 2
"""

P5_FOUND = f"""
with r as (select distinct record_id, {BOARD} as board, package, viewpoint, lower(image_name) as name,
    (list_min(list_transform(points, lambda p: p[1])) + list_max(list_transform(points, lambda p: p[1]))) / 2 as x,
    coalesce({joint_class('"class"')}, {joint_class('raw_label')}, {joint_class("split_part(merged_from, '+', 1)")}) as stated from polygons),
g as (select *, coalesce(x - lag(x) over (partition by board, package, viewpoint, name order by x, record_id) >= 200, true) as starts from r),
j as (select *, sum(starts::int) over (partition by board, package, viewpoint, name order by x, record_id) as joint from g)
select min(record_id) as set_id, case min(case stated when 'insufficient' then 0 when 'spike' then 1 when 'excess' then 2 when 'normal' then 3 end)
    when 0 then 'insufficient' when 1 then 'spike' when 2 then 'excess' when 3 then 'normal' end as class, joint::int as polygon_rank_x
from j group by board, package, viewpoint, name, joint having count(distinct record_id) > 1
"""

P6_FOUND = f"""
with c as (select distinct {CROP} as key, {BOARD} as board, package, {joint_class('class_name')} as class_name from crops),
t as (select *, {joint_class('class_name')} as class from targets)
select target_id from (
  select t.target_id, min_count, target_pct::bigint * sample_size as share, count(distinct key) as have
  from t left join c on c.board = t.board and c.class_name = t.class and (t.package is null or c.package = t.package)
  group by all)
where have < min_count or have * 100 < share
"""


_QUOTAS = f"""
c as (select distinct {CROP} as key, {BOARD} as board, package, {joint_class('class_name')} as class_name from crops),
t as (select *, {joint_class('class_name')} as class from targets),
h as (select t.target_id, count(distinct key) as have from t left join c on c.board = t.board and c.class_name = t.class and (t.package is null or c.package = t.package) group by 1),
l as (select t.*, have, least(greatest(coalesce(min_count, 0), 0), have) as lo, coalesce(target_pct, 0)::bigint as p, max(coalesce(sample_size, 0)) over (partition by plan_id)::bigint as size from t join h using (target_id)),
e as (select distinct plan_id, unnest([lo, have]) as num, p as den from l where p > 0),
enough as (select e.plan_id, num, den from e join l using (plan_id) group by 1, 2, 3
  having sum(case when l.p > 0 then least(greatest(l.lo * den, num * l.p), l.have * den) else l.lo * den end) >= max(l.size) * den),
level as (select plan_id, num, den from enough qualify row_number() over (partition by plan_id order by num::double / den, num) = 1),
w as (select l.*, num, den, sum(lo) over (partition by plan_id) >= size or max(p) over (partition by plan_id) = 0 as floors from l left join level using (plan_id)),
f as (select *, not floors and num is not null and p > 0 and lo * den < num * p and num * p <= have * den as grows,
  case when floors or p = 0 then lo when num is null then have when num * p <= lo * den then lo else have end as fixed from w),
g as (select *, size - sum(case when grows then 0 else fixed end) over (partition by plan_id) as rest, sum(case when grows then p else 0 end) over (partition by plan_id) as share from f),
b as (select *, case when grows then rest * p // share else fixed end as base, case when grows then rest * p % share end as over from g),
k as (select *, case when grows then row_number() over (partition by plan_id, grows order by over desc, target_id) end as place, size - sum(base) over (partition by plan_id) as left_over from b),
q as (select *, (base + case when grows and place <= left_over then 1 else 0 end)::bigint as quota from k),
named as (select plan_id, board, class, list(distinct package) filter (where package is not null) as taken from t group by 1, 2, 3),
drawn as (select q.plan_id, q.target_id, c.key as crop_id from q join named on named.plan_id = q.plan_id and named.board = q.board and named.class = q.class
  join (select distinct * from c where key is not null and class_name is not null) c on c.board = q.board and c.class_name = q.class
    and case when q.package is not null then c.package = q.package else c.package is null or not list_contains(coalesce(taken, []), c.package) end
  group by q.plan_id, q.target_id, q.quota, c.key
  qualify row_number() over (partition by q.plan_id, q.target_id order by ('0x' || substr(md5('0:' || c.key), 1, 13))::bigint, c.key) <= q.quota)"""

P6_SAMPLE = f"with {_QUOTAS} select plan_id, target_id, crop_id from drawn"

P6_REPORT = f"""
with {_QUOTAS}, n as (select target_id, count(*) as drawn from drawn group by 1)
select target_id, plan_id, board, sample_size, class as class_name, package, target_pct, min_count, have, quota, coalesce(drawn, 0) as drawn,
  coalesce(have < min_count, false) as short_by_count, have * 100 < coalesce(target_pct::bigint * sample_size, 0) as short_by_share from q left join n using (target_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_sample": P2_SAMPLE, "p2_growth": P2_GROWTH, "p3_found": P3_FOUND, "p3_groups": P3_GROUPS, "p3_split": P3_SPLIT,
        "p4_found": P4_FOUND, "p4_report": P4_REPORT, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p6_sample": P6_SAMPLE, "p6_report": P6_REPORT,
    }
