"""Queries of the reference's operators over the inspection tables, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jointmill.functions import geometry, labels, paths, scores
from jointmill.operators import components, grouping, inventory, joins, metrics, polygons, sampling, similarity, splits, windows
from jointmill.plans.sql import CROPS, LOGITS, PHOTOS, RECORDS, SCORES, plain, split_name
from jointmill.session import table, written

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
FRAME = (2560, 1440)
RATIOS = (0.6, 0.2, 0.2)


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- prepared tables


def records(spark: SparkSession, d: str) -> DataFrame:
    """Records of polygons in plain form, rows delivered twice once, with their box."""
    p = table(spark, d, "polygons").select(
        "record_id", "image_name", paths.plain_path("dataset_path").alias("dataset_path"), paths.board_of("board", "dataset_path").alias("board"), "package", "viewpoint", "light_direction", "raw_label",
        F.coalesce(labels.joint_class("class"), labels.joint_class("raw_label")).alias("class"), "points", "merged_from",
    ).distinct()
    b = geometry.bbox("points")
    return p.withColumns({f"b{k}": b[k] for k in ("x0", "y0", "x1", "y1")})


def photos(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "photo_groups").select(
        "photo_id", "image_name", paths.plain_path("dataset_path").alias("path"), paths.board_of("board", "dataset_path").alias("board"), "package", "viewpoint",
        F.nullif(paths.trimmed("group_id"), F.lit("")).alias("group_id"), paths.component_number("component_hint", "image_name").alias("number"), scores.fingerprint_hex("fingerprint").alias("print"),
    ).distinct()
    return p.withColumns({"cell": F.concat("board", F.lit("/"), "package"), "name": paths.file_name("path"), "folder": paths.folder("path"), "stem": paths.stem("path")})


def crops(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "crops").select(
        paths.crop_key("dataset_path", "polygon_rank_x").alias("crop_id"), labels.joint_class("class_name").alias("class"), labels.split_name("split").alias("split"), "group_id",
        paths.board_of("board", "dataset_path").alias("board"), "package",
    )
    return c.groupBy("crop_id").agg(*[F.min(x).alias(x) for x in ("class", "split", "group_id", "board", "package")])


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("run_id", "crop_id", "label", "pred", "score").distinct()


def with_logits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("run_id", "crop_id", "label", "logits").distinct()


# ---- scores

_SWEEP = f"""
{SCORES},
s as (select run_id, score as threshold, sum((label <> 0)::int) as pos, sum((label = 0)::int) as neg from sc where score is not null and not isnan(score) and label is not null group by 1, 2),
c as (select *, sum(pos) over w as cp, sum(neg) over w as cn, sum(pos) over (partition by run_id) as p, sum(neg) over (partition by run_id) as n from s window w as (partition by run_id order by threshold desc)),
sw as (select *, case when p > 0 then (p - cp)::double / p else 0.0 end as miss, case when n > 0 then cn::double / n else 0.0 end as far from c)"""


def _sweep(spark, d):
    return metrics.threshold_sweep(scored(spark, d), "score", F.col("label") != 0, ["run_id"])


@query(f"with {_SWEEP} select run_id, threshold, miss, far, (cp + cn)::bigint as flagged from sw")
def sweep_thresholds(spark, d):
    """Miss and false-alarm rate of every run at every distinct score."""
    return _sweep(spark, d).select("run_id", "threshold", "miss", "far", F.col("flagged").cast("long").alias("flagged"))


@query(f"""with {SCORES},
s as (select score as threshold, sum((label <> 0)::int) as pos, sum((label = 0)::int) as neg from sc where score is not null and not isnan(score) group by 1),
c as (select *, sum(pos) over w as cp, sum(neg) over w as cn, sum(pos) over () as p, sum(neg) over () as n from s window w as (order by threshold desc))
select threshold, (p - cp)::double / p as miss, cn::double / n as far, (cp + cn)::bigint as flagged from c""")
def sweep_all_runs(spark, d):
    """The sweep over all rows together: its running sums are cut into value ranges."""
    s = metrics.threshold_sweep(scored(spark, d), "score", F.col("label") != 0)
    return s.select("threshold", "miss", "far", F.col("flagged").cast("long").alias("flagged"))


@query(f"""with {_SWEEP}, l as (select unnest([0.10, 0.05, 0.0])::double as max_miss), r as (select distinct run_id from sw),
b as (select r.run_id, max_miss, max(threshold) as threshold from r cross join l left join sw on sw.run_id = r.run_id and miss <= max_miss group by 1, 2)
select b.run_id, max_miss, b.threshold, miss, far from b left join sw on sw.run_id = b.run_id and sw.threshold = b.threshold""")
def operating_points(spark, d):
    return metrics.operating_points(_sweep(spark, d), [0.10, 0.05, 0.0], ["run_id"])


@query(f"with {_SWEEP} select run_id, round(case when max(p) * max(n) > 0 then sum(neg * (cp - pos) + neg * pos / 2.0) / (max(p) * max(n)) end, 9)::double as auroc from sw group by 1")
def auroc(spark, d):
    return metrics.auroc(_sweep(spark, d), ["run_id"]).withColumn("auroc", F.round("auroc", 9))


@query(f"with {_SWEEP} select run_id, round(case when max(p) > 0 then sum(pos * (cp::double / (cp + cn))) / max(p) end, 9) as auprc from sw group by 1")
def auprc(spark, d):
    return metrics.auprc(_sweep(spark, d), ["run_id"]).withColumn("auprc", F.round("auprc", 9))


_GRID = "grid as (select t.i as truth, p.i as pred from range(4) t(i) cross join range(4) p(i))"
_CONF = f"""{LOGITS}, {_GRID},
k as (select label as truth, list_position(logits, list_max(logits)) - 1 as pred, count(*) as n from sc group by 1, 2),
conf as (select truth::int as truth, pred::int as pred, coalesce(n, 0) as n from grid left join k using (truth, pred))"""


def _confusion(spark, d):
    return metrics.confusion(with_logits(spark, d).withColumn("guess", scores.argmax("logits")), "label", "guess")


@query(f"with {_CONF} select truth, pred, n, case when sum(n) over (partition by truth) > 0 then n::double / sum(n) over (partition by truth) else 0.0 end as share from conf")
def confusion_matrix(spark, d):
    """Dense class grid of truth and the largest logit."""
    return _confusion(spark, d)


@query(f"""with {_CONF}, t as (select truth, sum(n) as support, sum(case when truth = pred then n else 0 end) as hits from conf group by 1),
p as (select pred as truth, sum(n) as predicted from conf group by 1)
select truth, support::bigint as support, case when support > 0 then hits::double / support else 0 end as recall, predicted::bigint as predicted,
case when predicted > 0 then hits::double / predicted else 0 end as precision, case when support + predicted > 0 then (2 * hits)::double / (support + predicted) else 0 end as f1 from t join p using (truth)""")
def class_recalls(spark, d):
    return metrics.recalls(_confusion(spark, d))


@query(f"""with {_CONF} select row_number() over (order by n desc, truth, pred)::int as rank, truth, pred, n from conf where truth <> pred and n > 0""")
def mistake_order(spark, d):
    return metrics.mistakes(_confusion(spark, d))


@query(f"""with {SCORES}, v as (select distinct label, pred, score, run_id || '/' || crop_id as item from sc where score is not null and not isnan(score) and pred between 0 and 3),
r as (select *, row_number() over (partition by label, pred order by case when pred = 0 then score else -score end, item) as place, count(*) over (partition by label, pred) as total from v)
select label, pred, place::int as place, item, score, total from r where place <= 5""")
def gallery_top(spark, d):
    """The five first predictions of each true × predicted cell of all runs."""
    v = scored(spark, d).where("score is not null and not isnan(score) and pred between 0 and 3")
    v = v.select("label", "pred", "score", F.concat("run_id", F.lit("/"), "crop_id").alias("item")).distinct()
    return metrics.gallery(v, "label", "pred", "score", "item", 5)


@query(f"with {SCORES} select run_id, round(avg((label = pred)::int), 9) as accuracy from sc where label is not null and pred is not null group by 1")
def run_accuracy(spark, d):
    return metrics.accuracy(scored(spark, d), "label", "pred", ["run_id"]).withColumn("accuracy", F.round("accuracy", 9))


_RUNS = f"""{_SWEEP},
g as (select r.run_id, t.i as truth from (select distinct run_id from sc) r cross join range(4) t(i)),
rc as (select g.run_id, truth, coalesce(avg((sc.pred = truth)::int) filter (where sc.pred between 0 and 3), 0) as recall0, sum((sc.pred = truth)::int) as hits, count(sc.pred) filter (where sc.pred between 0 and 3) as support
    from g left join sc on sc.run_id = g.run_id and sc.label = truth group by 1, 2),
m as (select run_id, avg(case when support > 0 then hits::double / support else 0 end) as macro_recall, max(case when truth = 0 then case when support > 0 then hits::double / support else 0 end end) as normal_recall from rc group by 1),
a as (select run_id, case when max(p) * max(n) > 0 then sum(neg * (cp - pos) + neg * pos / 2.0) / (max(p) * max(n)) end as auroc, arg_max(far, threshold) filter (where miss <= 0.10) as far from sw group by 1),
rm as (select m.run_id, macro_recall, normal_recall, auroc::double as auroc, coalesce(far, 'nan'::double) as far from m left join a using (run_id))"""


@query(f"with {_RUNS} select run_id, round(macro_recall, 9) as macro_recall, round(normal_recall, 9) as normal_recall, round(auroc, 9) as auroc, far from rm")
def run_metrics(spark, d):
    """Macro recall, normal recall, AUROC and false alarms at a miss rate of 0.10 of every run."""
    m = metrics.run_metrics(scored(spark, d), "label", "pred", "score")
    return m.withColumns({c: F.round(c, 9) for c in ("macro_recall", "normal_recall", "auroc")})


@query(f"""with {_RUNS}, o as (select right(run_id, 1) as option, * from rm)
select option, count(*) as n, round(avg(macro_recall), 9) as macro_recall_mean, round(stddev_samp(macro_recall), 9) as macro_recall_std,
round(avg(auroc), 9) as auroc_mean, round(stddev_samp(auroc), 9) as auroc_std, round(avg(far) filter (where not isnan(far)), 9) as far_mean, round(stddev_samp(far) filter (where not isnan(far)), 9) as far_std from o group by 1""")
def run_summary(spark, d):
    """Mean and sample deviation over the runs of an option (here the last character of the run)."""
    m = metrics.run_metrics(scored(spark, d), "label", "pred", "score").withColumn("option", F.substring("run_id", -1, 1))
    s = metrics.mean_std(m, ["macro_recall", "auroc", "far"], ["option"])
    return s.withColumns({c: F.round(c, 9) for c in s.columns if c.endswith(("_mean", "_std"))})


@query(f"with {SCORES} select run_id, round(sum(score * (label + 1)) / sum(label + 1), 11) as mean from sc where score is not null and not isnan(score) group by 1")
def weighted_score_mean(spark, d):
    s = scored(spark, d).where("not isnan(score)").withColumn("w", F.col("label") + 1)
    return metrics.weighted_mean(s, "score", "w", ["run_id"]).where("mean is not null").withColumn("mean", F.round("mean", 11))


@query(f"with {LOGITS}, z as (select run_id, crop_id, list_transform(logits, lambda x: x::double) as z from sc) select distinct run_id, crop_id, round(1 - exp(z[1] - list_max(z)) / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 9) as defect from z")
def defect_scores(spark, d):
    return with_logits(spark, d).select("run_id", "crop_id", F.round(scores.defect_score("logits"), 9).alias("defect")).distinct()


# ---- splits and classes

_DENSE = f"""{CROPS}, dense as (select s.split, c.class, count(crop_id) as n from (select unnest(['train', 'val', 'test']) as split) s
cross join (select unnest(['normal', 'excess', 'insufficient', 'spike']) as class) c left join cr on cr.split = s.split and cr.class = c.class group by 1, 2)"""


@query(f"with {_DENSE} select * from dense")
def class_counts(spark, d):
    return splits.dense_counts(crops(spark, d), "split", "class")


@query(f"""with {CROPS}, k as (select split, count(distinct group_id) as groups, count(*) as crops, sum((class = 'normal')::int)::bigint as normal, sum((class = 'excess')::int)::bigint as excess,
sum((class = 'insufficient')::int)::bigint as insufficient, sum((class = 'spike')::int)::bigint as spike from cr where split is not null and class is not null group by 1)
select * from k union all select 'total', sum(groups)::bigint, sum(crops)::bigint, sum(normal)::bigint, sum(excess)::bigint, sum(insufficient)::bigint, sum(spike)::bigint from k""")
def count_table(spark, d):
    c = crops(spark, d).where("split is not null and class is not null")
    return splits.count_table(c, "split", "class", "group_id")


@query(f"with {_DENSE} select split, class, n, case when class = 'normal' then 12 else 8 end as floor, n - case when class = 'normal' then 12 else 8 end as slack from dense where split <> 'train'")
def gate_margins(spark, d):
    return splits.gate_margins(splits.dense_counts(crops(spark, d), "split", "class"), "split", "class")


@query(f"with {CROPS} select group_id, count(distinct split) as splits from cr where group_id is not null group by 1 having count(distinct split) > 1")
def split_leaks(spark, d):
    return splits.leaks(crops(spark, d), "group_id")


_CANDIDATES = f"""{CROPS}, z as (select coalesce(group_id, crop_id) as g, class, count(*) as n from cr where class is not null group by 1, 2),
e as (select c.i as candidate, class, n, (('0x' || substr(md5(c.i::varchar || ':' || g), 1, 8))::bigint % 5) as fold from z cross join range(20) c(i)),
f as (select candidate, case when fold < 3 then 'train' when fold < 4 then 'val' else 'test' end as split, class, sum(n) as n from e group by 1, 2, 3),
w as (select c.i as candidate, s.split, k.class, coalesce(f.n, 0) as n from range(20) c(i) cross join (select unnest(['train', 'val', 'test']) as split) s cross join (select distinct class from z) k
  left join f on f.candidate = c.i and f.split = s.split and f.class = k.class),
t as (select *, sum(n) over (partition by candidate, split) as s, sum(n) over (partition by candidate, class) as l, sum(n) over (partition by candidate) as t from w),
per as (select candidate, max((split <> 'train' and class = 'normal' and n < 12)::int) as fails_normal, max((split <> 'train' and class <> 'normal' and n < 8)::int) as fails_defect,
  sum(case when s > 0 then abs(n::double / s - l::double / t) else 1.0 end) as class_deviation from t group by 1),
size as (select candidate, sum(abs(s::double / t - case when split = 'train' then 0.6 else 0.2 end)) as size_deviation from (select distinct candidate, split, s, t from t) group by 1)"""


def _grouped(spark, d):
    return crops(spark, d).where("class is not null").withColumn("g", F.coalesce("group_id", "crop_id"))


@query(f"with {_CANDIDATES} select candidate::int as candidate, fails_normal, fails_defect, round(class_deviation, 9) as class_deviation, round(size_deviation, 9) as size_deviation from per join size using (candidate)")
def split_candidates(spark, d):
    s = splits.scored(splits.candidates(_grouped(spark, d), "g", "class", RATIOS, 20), "class", RATIOS)
    return s.withColumns({c: F.round(c, 9) for c in ("class_deviation", "size_deviation")})


@query(f"""with {_CANDIDATES}, best as (select candidate from per join size using (candidate) where fails_normal = 0 and fails_defect = 0 order by round(class_deviation, 12), round(size_deviation, 12), candidate limit 1),
a as (select cr.*, ('0x' || substr(md5(candidate::varchar || ':' || coalesce(group_id, crop_id)), 1, 8))::bigint % 5 as fold from cr cross join best where class is not null)
select crop_id, case when fold < 3 then 'train' when fold < 4 then 'val' else 'test' end as split from a""")
def split_chosen(spark, d):
    """Assignment of the best of twenty candidates."""
    return splits.choose(_grouped(spark, d), "g", "class", RATIOS, 20)[0].select("crop_id", "split")


#: Fixed value: candidates of the reference's search.
SEARCHED = 200
_CANDIDATES_WHOLE = _CANDIDATES.replace("range(20)", f"range({SEARCHED})")


@query(f"with {_CANDIDATES_WHOLE} select candidate::int as candidate, fails_normal, fails_defect, round(class_deviation, 9) as class_deviation, round(size_deviation, 9) as size_deviation from per join size using (candidate)")
def split_candidates_whole(spark, d):
    """Gates and deviations of all candidates of the reference's search."""
    s = splits.scored(splits.candidates(_grouped(spark, d), "g", "class", RATIOS, SEARCHED), "class", RATIOS)
    return s.withColumns({c: F.round(c, 9) for c in ("class_deviation", "size_deviation")})


_PLAIN_ID = plain("substr(crop_id, 1, length(crop_id) - length(split_part(crop_id, '#', -1)) - 1)") + " || '#' || trim(split_part(crop_id, '#', -1))"


@query(f"""with a as (select distinct seed, choice_index, {_PLAIN_ID} as crop_id, {split_name('split')} as split from assignments)
select seed, choice_index, sha256(string_agg(crop_id || ',' || split, chr(10) order by crop_id || ',' || split)) as split_hash from a group by 1, 2""")
def split_hash(spark, d):
    """Content hash of every frozen choice."""
    a = table(spark, d, "assignments").select("seed", "choice_index", paths.plain_crop_id("crop_id").alias("crop_id"), labels.split_name("split").alias("split")).distinct()
    return splits.split_hash(a, "crop_id", "split", ["seed", "choice_index"])


@query(f"""with a as (select distinct seed, choice_index, {_PLAIN_ID} as crop_id, {split_name('split')} as split from assignments),
p as (select seed, choice_index, ('0x' || substr(md5(crop_id), 1, 8))::bigint % 4096 as part, sha256(string_agg(crop_id || ',' || split, chr(10) order by crop_id || ',' || split)) as h, count(*) as k from a group by 1, 2, 3)
select seed, choice_index, sha256(string_agg(h, '' order by h)) as fingerprint, sum(k)::bigint as n from p group by 1, 2""")
def split_fingerprint(spark, d):
    """Content hash of every frozen choice from the digests of hash parts, which scales."""
    a = table(spark, d, "assignments").select("seed", "choice_index", paths.plain_crop_id("crop_id").alias("crop_id"), labels.split_name("split").alias("split")).distinct()
    return splits.split_fingerprint(a, "crop_id", "split", ["seed", "choice_index"])


_COUNTED = f"{CROPS}, k as (select class, count(*) as n from cr where class is not null group by 1)"


@query(f"with {_COUNTED} select class, n, round((1.0::double / n) * 4 / sum(1.0::double / n) over (), 9) as weight from k")
def class_weights_inverse(spark, d):
    c = crops(spark, d).where("class is not null").groupBy("class").agg(F.count("*").alias("n"))
    return sampling.class_weights(c, "class", "n").withColumn("weight", F.round("weight", 9))


@query(f"with {_COUNTED}, w as (select class, n, (1 - 0.999::double) / (1 - pow(0.999::double, n)) as w from k) select class, n, round(w * 4 / sum(w) over (), 9) as weight from w")
def class_weights_effective(spark, d):
    c = crops(spark, d).where("class is not null").groupBy("class").agg(F.count("*").alias("n"))
    return sampling.class_weights(c, "class", "n", "effective", 0.999).withColumn("weight", F.round("weight", 9))


@query(f"with {RECORDS}, k as (select class, count(*) as n from rec where class is not null group by 1) select class, n, row_number() over (order by n desc, class)::int as rank from k")
def ordered_classes(spark, d):
    return inventory.ranked_counts(records(spark, d).where("class is not null"), "class")


@query(f"with {CROPS} select class, crop_id from cr where class is not null qualify row_number() over (partition by class order by md5('7:' || crop_id), crop_id) <= 64")
def seeded_sample(spark, d):
    """64 crops a class in a fixed pseudorandom order: the sample is the feature."""
    return sampling.seeded_sample(crops(spark, d).where("class is not null").select("class", "crop_id"), "crop_id", 64, 7, ["class"])


@query(f"""with {CROPS}, g as (select group_id, count(*) as n from cr where group_id is not null group by 1), top as (select * from g order by n desc, group_id limit 10)
select group_id, n, 'largest' as why from top union all
(select group_id, n, 'sample' from g where group_id not in (select group_id from top) order by md5('7:' || group_id), group_id limit 20)""")
def largest_and_sampled_groups(spark, d):
    g = crops(spark, d).where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n"))
    return sampling.largest_and_sample(g, "group_id", "n", 10, 20, 7)


@query(f"""with {CROPS}, c as (select * from cr where class is not null), k as (select class, count(*) as n from c group by 1), w as (select class, n, (1.0::double / n) * (count(*) over ()) / sum(1.0::double / n) over () as weight from k),
s as (select class, n, round(weight * 1000000)::bigint * n as slots from w), u as (select *, sum(slots) over (order by class) as upto, sum(slots) over () as total from s),
p as (select class, crop_id, row_number() over (partition by class order by ('0x' || substr(md5('7:' || crop_id), 1, 13))::bigint, crop_id) - 1 as place from c),
i as (select unnest(range((select count(*) from c))) as draw), h as (select draw, ('0x' || substr(md5('7:slot:' || draw), 1, 15))::bigint as a, ('0x' || substr(md5('7:row:' || draw), 1, 15))::bigint as b from i),
e as (select draw, class, b % n as place from h join u on a % total < upto and a % total >= upto - slots)
select draw, crop_id, class from e join p using (class, place)""")
def weighted_sample(spark, d):
    """As many draws as crops, classes evened out by inverse frequency."""
    c = crops(spark, d).where("class is not null")
    w = sampling.class_weights(c.groupBy("class").agg(F.count("*").alias("n")), "class", "n")
    return sampling.weighted_sample(c, "crop_id", "class", w, c.count(), 7)


# ---- polygons

_AREA = "abs(list_sum(list_transform(range(1, len(points) + 1), lambda i: points[i][1] * points[(i % len(points)) + 1][2] - points[(i % len(points)) + 1][1] * points[i][2]))) / 2"


@query(f"""with {RECORDS}, v as (select class, package, bx1 - bx0 as w, by1 - by0 as h, case when len(points) >= 3 then {_AREA} else 0 end as area from box)
select class, package, count(*) as n, round(avg(w), 6) as mean_w, median(w) as median_w, round(avg(h), 6) as mean_h, median(h) as median_h, round(avg(area), 6) as mean_area, median(area) as median_area from v group by 1, 2""")
def box_stats(spark, d):
    s = polygons.box_stats(records(spark, d), ["class", "package"])
    return s.withColumns({f"mean_{c}": F.round(f"mean_{c}", 6) for c in ("w", "h", "area")})


@query(f"""with {RECORDS}, e as (select record_id, bx0 - (bx1 - bx0) * 0.1::double as x0, by0 - (by1 - by0) * 0.1::double as y0, bx1 + (bx1 - bx0) * 0.1::double as x1, by1 + (by1 - by0) * 0.1::double as y1 from box),
q as (select record_id, case when x1 - x0 >= y1 - y0 then x0 else (x0 + x1) / 2 - (y1 - y0) / 2 end as x0, case when x1 - x0 >= y1 - y0 then (y0 + y1) / 2 - (x1 - x0) / 2 else y0 end as y0,
  case when x1 - x0 >= y1 - y0 then x1 else (x0 + x1) / 2 + (y1 - y0) / 2 end as x1, case when x1 - x0 >= y1 - y0 then (y0 + y1) / 2 + (x1 - x0) / 2 else y1 end as y1 from e),
s as (select record_id, floor(x0) as x, floor(y0) as y, greatest(ceil(x1) - floor(x0), ceil(y1) - floor(y0)) as side from q),
f as (select record_id, greatest(0, least(x, 2560 - least(side, 2560))) as x, greatest(0, least(y, 1440 - least(side, 1440))) as y, least(side, 2560) as w, least(side, 1440) as h from s)
select record_id, x::bigint as x0, y::bigint as y0, (x + w)::bigint as x1, (y + h)::bigint as y1 from f""")
def square_crops(spark, d):
    """Square training crop of every record in a full frame."""
    r = records(spark, d).withColumn("c", geometry.square_crop(F.struct(*[F.col(f"b{k}").alias(k) for k in ("x0", "y0", "x1", "y1")]), 0.1, F.lit(FRAME[0]), F.lit(FRAME[1])))
    return r.select("record_id", *[F.col(f"c.{k}").cast("long").alias(k) for k in ("x0", "y0", "x1", "y1")])


@query(f"""with {RECORDS}, m as (select *, 0.2::double * greatest(bx1 - bx0, by1 - by0) as m from box)
select record_id, greatest(0, floor(bx0 - m))::bigint as x0, greatest(0, floor(by0 - m))::bigint as y0, least(2560, ceil(bx1 + m))::bigint as x1, least(1440, ceil(by1 + m))::bigint as y1 from m""")
def isotropic_crops(spark, d):
    r = records(spark, d).withColumn("c", geometry.clamped_box(F.struct(*[F.col(f"b{k}").alias(k) for k in ("x0", "y0", "x1", "y1")]), 0.2, F.lit(FRAME[0]), F.lit(FRAME[1])))
    return r.select("record_id", *[F.col(f"c.{k}").cast("long").alias(k) for k in ("x0", "y0", "x1", "y1")])


@query(f"with {RECORDS} select record_id, row_number() over (partition by dataset_path order by list_sum(list_transform(points, lambda p: p[1])) / len(points), record_id)::int as rank from rec")
def rank_by_x(spark, d):
    """Rank of every record in its photo by the mean x of its vertices."""
    r = records(spark, d).withColumn("x", geometry.vertex_mean_x("points"))
    return windows.rank_within(r, ["dataset_path"], ["x", "record_id"]).select("record_id", "rank")


_CLUSTERS = f"""{RECORDS}, x as (select *, (bx0 + bx1) / 2 as x from box),
g as (select *, row_number() over w as rn, lead(x) over w - x as gap from x window w as (partition by dataset_path order by x, record_id)),
cut as (select dataset_path, arg_max(rn, (gap, -rn)) as cut from g where gap is not null group by 1),
cl as (select g.*, case when cut is null or rn <= cut then 1 else 2 end as cluster from g left join cut using (dataset_path))"""


@query(f"with {_CLUSTERS} select record_id, cluster from cl")
def largest_gap_clusters(spark, d):
    r = records(spark, d).withColumn("x", (F.col("bx0") + F.col("bx1")) / 2)
    return windows.largest_gap_clusters(r, ["dataset_path"], "x", "record_id").select("record_id", "cluster")


_CLASSED = f"""{RECORDS}, x as (select *, (bx0 + bx1) / 2 as x from box),
g as (select *, row_number() over w as rn, lead(x) over w - x as gap from x where class is not null window w as (partition by dataset_path order by x, record_id)),
cut as (select dataset_path, arg_max(rn, (gap, -rn)) as cut from g where gap is not null group by 1),
cl as (select g.*, case when cut is null or rn <= cut then 1 else 2 end as cluster from g left join cut using (dataset_path))"""
_MERGED = f"""{_CLASSED}, k as (select *, case class when 'insufficient' then 0 when 'spike' then 1 when 'excess' then 2 when 'normal' then 3 end as p from cl),
o as (select *, row_number() over (partition by dataset_path, cluster order by x, record_id) as r, row_number() over (partition by dataset_path, cluster, class order by x, record_id) as c from k),
q as (select *, min(r) over (partition by dataset_path, cluster, class) as f, min(p * 1000000 + r) over (partition by dataset_path, cluster) = p * 1000000 + r as kept from o),
m as (select dataset_path, cluster, max(record_id) filter (where kept) as record_id, max(class) filter (where kept) as class, count(*) as n, min(bx0) as x0, min(by0) as y0, max(bx1) as x1, max(by1) as y1,
  case when count(*) > 1 then string_agg(class, '+' order by case when kept then 0 when c > 1 then 1 else 2 end, case when kept then 0 when c > 1 then f else p end, r) else '' end as merged_from from q group by 1, 2)"""


@query(f"""with {_MERGED} select dataset_path, record_id, class, merged_from, n, x0, y0, x1, y1, row_number() over w::int as polygon_rank_x, (count(*) over (partition by dataset_path))::int as polygon_count,
case when row_number() over w = 1 then 'left' when row_number() over w = count(*) over (partition by dataset_path) then 'right' else 'middle' end as joint_position
from m window w as (partition by dataset_path order by (x0 + x1) / 2, record_id)""")
def merged_joints(spark, d):
    """At most two joints a photo: clusters at the largest gap, each reduced to its first class in merge order."""
    r = records(spark, d).where("class is not null")
    j = windows.merged_joints(r, ["dataset_path"], "class", "record_id", ["bx0", "by0", "bx1", "by1"])
    return j.select("dataset_path", "record_id", "class", "merged_from", "n", "x0", "y0", "x1", "y1", "polygon_rank_x", "polygon_count", "joint_position")


@query(f"""with {RECORDS} select dataset_path, arg_min(image_name, record_id) as image_name, arg_min(board, record_id) as board, arg_min(package, record_id) as package, count(*) as records,
min(bx0) as x0, min(by0) as y0, max(bx1) as x1, max(by1) as y1, coalesce('C' || nullif(regexp_extract(regexp_replace(regexp_replace(dataset_path, '^.*/', ''), '\\.[^.]*$', ''), '_C(\\d+)$', 1), ''), '') as component_hint from box group by 1""")
def photo_records(spark, d):
    """One row a photo: first record's facts and the box around all its polygons."""
    return polygons.photos(records(spark, d).select("record_id", "dataset_path", "image_name", "board", "package", "points"), "dataset_path", "record_id", ["image_name", "board", "package"])


@query(f"""with {RECORDS}, {CROPS.strip()}, r as (select *, row_number() over (partition by dataset_path order by (bx0 + bx1) / 2, record_id) as k from box),
j as (select r.*, cr.group_id, cr.split from r join cr on cr.crop_id = r.dataset_path || '#' || r.k where cr.split is not null)
select board || '_' || package || '_' || replace(viewpoint, '.', '_') || '_' || regexp_replace(regexp_replace(dataset_path, '^.*/', ''), '\\.[^.]*$', '') || '_' || k || '.png' as image_file, dataset_path as source_path, group_id, split, class as label,
bx1 - bx0 as bbox_w, by1 - by0 as bbox_h, case when len(points) >= 3 then {_AREA} else 0 end as polygon_area from j""")
def crop_manifest(spark, d):
    """Crops of the records that have a split, with labels, ids and boxes."""
    r = windows.positions(records(spark, d), ["dataset_path"], (F.col("bx0") + F.col("bx1")) / 2, "record_id")
    m = polygons.manifest(r, crops(spark, d).where("split is not null"), 0.1, *FRAME)
    return m.select("image_file", "source_path", "group_id", "split", "label", "bbox_w", "bbox_h", "polygon_area")


# ---- inventory of photos

_ANCHOR = "list_position(list_transform(string_split(folder, '/'), lambda p: regexp_matches(p, '^V\\d+(\\.\\d+)?$')), true)"


@query(f"""with {PHOTOS}, a as (select *, string_split(folder, '/') as s, {_ANCHOR} as pos from pn),
f as (select path, case when pos > 2 then s[pos - 2] end as board, case when pos > 1 then s[pos - 1] end as package, case when pos > 0 then s[pos] end as viewpoint,
  case when pos > 0 and regexp_matches(s[pos + 1], '^Setup\\d+$') then s[pos + 1] end as setup, stem from a)
select distinct path, board, package, viewpoint, setup, package in ('R0603', 'R0805', 'R1206', 'C0805') as in_scope, case viewpoint when 'V1' then 'placement' when 'V2' then 'joint' when 'V2.1' then 'joint' end as task,
case when regexp_matches(stem, '^WIN_\\d{{8}}_\\d\\d_\\d\\d_\\d\\d_Pro$') then regexp_replace(stem, '^WIN_(\\d{{4}})(\\d\\d)(\\d\\d)_(\\d\\d)_(\\d\\d)_(\\d\\d)_Pro$', '\\1-\\2-\\3T\\4:\\5:\\6') end as captured,
coalesce('C' || nullif(regexp_extract(stem, '_C(\\d+)$', 1), ''), '') as hint from f""")
def path_facts(spark, d):
    """Board, package, viewpoint, setup, task, scope, time and hint that the photo paths tell."""
    f = inventory.described(photos(spark, d).select("path").distinct())
    return f.select("path", "board", "package", "viewpoint", "setup", "in_scope", "task", paths.capture_timestamp("stem").alias("captured"), paths.component_hint("stem").alias("hint"))


_POSITIONS = """e as (select path, unnest({tokens}) as value, generate_subscripts({tokens}, 1) - 1 as position from (select distinct path, stem, folder from pn)),
c as (select position, value, count(*) as n, min(path) as first from e group by 1, 2),
top as (select position, string_agg(value, '|' order by n desc, first) as examples from (select * from c qualify row_number() over (partition by position order by n desc, first) <= 4) group by 1)
select c.position::int as position, count(*) as distinct, sum(n)::bigint as total, min(n) as min_n, median(n)::double as median_n, max(n) as max_n,
case when count(*) <= 1 then 'constant' when count(*) >= sum(n) then 'unique' else 'grouping' end as role, any_value(examples) as examples from c join top using (position) group by 1"""
_TOKENS = "list_filter(regexp_split_to_array(stem, '[_\\-.]'), lambda t: t <> '')"


@query(f"with {PHOTOS}, " + _POSITIONS.replace("{tokens}", _TOKENS).replace(" as distinct", ' as "distinct"'))
def token_positions(spark, d):
    """What the tokens of the photo names vary in, by position."""
    return inventory.position_table(photos(spark, d).select("path", "stem").distinct(), inventory.name_tokens("stem"), "path")


@query(f"with {PHOTOS}, " + _POSITIONS.replace("{tokens}", "string_split(folder, '/')").replace(" as distinct", ' as "distinct"'))
def segment_positions(spark, d):
    return inventory.position_table(photos(spark, d).select("path", "folder").distinct(), F.split("folder", "/"), "path")


@query(f"""with {PHOTOS}, t as (select distinct path, len({_TOKENS}) as n_tokens from pn), m as (select n_tokens as m from t group by 1 order by count(*) desc, min(path) limit 1)
select path, n_tokens::int as n_tokens from t cross join m where n_tokens <> m""")
def token_outliers(spark, d):
    return inventory.token_outliers(photos(spark, d).select("path", "stem").distinct(), inventory.name_tokens("stem"), "path").select("path", "n_tokens")


@query("select md5(text) as hash, count(*) as n, coalesce(string_agg(distinct source, '|' order by source), '') as places from documents where text is not null group by 1 having count(*) > 1")
def duplicate_texts(spark, d):
    """Texts that occur more than once, with the sources they occur in."""
    return inventory.duplicate_contents(table(spark, d, "documents").where("text is not null"), "text", "source")


@query(f"""with {PHOTOS}, p as (select lower(name) as name, list_aggregate(list_sort(list(distinct folder)), 'string_agg', '|') as folders from pn group by 1 having count(distinct folder) > 1)
select folders, count(*) as names, array_to_string(list_sort(list(name))[1:2], '|') as examples from p group by 1""")
def mirrored_folders(spark, d):
    return inventory.mirrored_folders(photos(spark, d).withColumn("name", F.lower("name")), "name", "folder")


@query(f"""with {PHOTOS} select lower(name) as name, arg_max(path, (len(string_split(path, '/')), path)) as path, count(distinct path) - 1 as set_aside from pn group by 1""")
def deepest_copies(spark, d):
    """The deepest copy of every file name, and how many others there are."""
    return inventory.deepest(photos(spark, d).withColumn("name", F.lower("name")), "name", "path")


@query(f"""with {PHOTOS}, p as (select lower(name) as name, list_sort(list(distinct folder)) as places, count(*) as copies, count(distinct md5(print)) as k, count(print) as there from pn group by 1 having count(distinct folder) > 1),
s as (select places, count(*) as size, min(name) as head from p group by 1), j as (select p.*, size, name = head as h from p join s using (places))
select name, copies, case when there = copies then k = 1 end as identical from j order by h desc, case when h then -size else 0 end, name limit 30""")
def duplicate_sample(spark, d):
    """Thirty names with several copies and whether their content agrees: a report of this size is the feature."""
    return inventory.duplicate_sample(photos(spark, d).withColumn("name", F.lower("name")), "name", "folder", "print")


_CELLS = f"{PHOTOS}, c as (select board, package, viewpoint, count(*) as n from pn group by 1, 2, 3)"


@query(f"with {_CELLS} select board, package, count(*) as parts, sum(n)::bigint as total, min(n) as least, max(n) as most, min(n) < max(n) as ragged from c group by 1, 2")
def ragged_cells(spark, d):
    return inventory.ragged_cells(photos(spark, d), ["board", "package"], "viewpoint")


@query(f"""with {_CELLS} select board, package, coalesce(sum(n) filter (where viewpoint = 'V2'), 0)::bigint as "V2", coalesce(sum(n) filter (where viewpoint = 'V2.1'), 0)::bigint as "V2.1",
coalesce(sum(n) filter (where viewpoint in ('V2', 'V2.1')), 0)::bigint as total from c group by 1, 2""")
def coverage(spark, d):
    """Photos of every cell by viewpoint."""
    return inventory.coverage(photos(spark, d), ["board", "package"], "viewpoint", ["V2", "V2.1"])


@query(f"""with {PHOTOS}, {RECORDS.strip()}, a as (select distinct image_name as name, coalesce(nullif(regexp_extract(dataset_path, '^(.*)/[^/]*$', 1), ''), '.') as own from rec),
f as (select distinct name, folder, path from pn), j as (select a.name, own, f.path, f.folder <> own as outside from a left join f on f.name = a.name),
r as (select *, row_number() over (partition by name, own order by outside desc, string_split(path, '/')) as k, count(path) over (partition by name, own, outside) as n from j)
select name, own, path as resolved_path, n > 1 as ambiguous from r where k = 1""")
def resolved_annotations(spark, d):
    """The photo file every annotation means: by name, files outside its own folder first."""
    a = records(spark, d).select(F.col("image_name").alias("name"), paths.folder("dataset_path").alias("own")).distinct()
    files = photos(spark, d).select("name", "folder", "path").distinct()
    return joins.resolve_prefer_elsewhere(a, files, "name", "own").select("name", "own", "resolved_path", "ambiguous")


@query(f"with {CROPS} select distinct crop_id from predictions where crop_id not in (select crop_id from cr)")
def orphan_predictions(spark, d):
    """Predicted crops that crops lacks."""
    return joins.orphans(table(spark, d, "predictions"), crops(spark, d), ["crop_id"])


@query(f"""with {CROPS}, a as (select distinct {_PLAIN_ID} as crop_id from assignments)
select crop_id, 'assigned_only' as side from a where crop_id not in (select crop_id from cr) union all select crop_id, 'crops_only' from cr where crop_id not in (select crop_id from a)""")
def assignment_differences(spark, d):
    a = table(spark, d, "assignments").select(paths.plain_crop_id("crop_id").alias("crop_id"))
    return joins.symmetric_difference(a, crops(spark, d), ["crop_id"], ("assigned_only", "crops_only"))


@query(f"""with {CROPS}, {RECORDS.strip()}, m as (select p.dataset_path || '#' || p.polygon_rank_x as crop_id, min(merged_from) as merged_from from
(select {plain('dataset_path')} as dataset_path, polygon_rank_x, merged_from from polygons) p group by 1)
select cr.crop_id, class, coalesce(merged_from, '') as merged_from from cr left join m on m.crop_id = cr.crop_id""")
def crops_with_history(spark, d):
    """Every crop with what it was merged from, or an empty text."""
    m = table(spark, d, "polygons").select(paths.crop_key("dataset_path", "polygon_rank_x").alias("crop_id"), "merged_from").groupBy("crop_id").agg(F.min("merged_from").alias("merged_from"))
    return joins.left_with_default(crops(spark, d).select("crop_id", "class"), m, ["crop_id"], {"merged_from": ""})


_NUMBER = "case class when 'normal' then 0 when 'excess' then 1 when 'insufficient' then 2 when 'spike' then 3 end"


@query(f"""with {CROPS}, p as (select distinct run_id, crop_id, label from predictions), j as (select run_id, p.crop_id, label, class, cr.crop_id is null as gone from p left join cr on cr.crop_id = p.crop_id)
select run_id, crop_id, label, class, case when gone then 'no crop' else 'other label' end as reason from j where gone or {_NUMBER} is distinct from label or label is null""")
def predictions_off_manifest(spark, d):
    """Predictions made on another crop set: their crop is missing or its class isn't their label."""
    p = table(spark, d, "predictions").select("run_id", "crop_id", "label").distinct()
    return joins.off_manifest(p, crops(spark, d).select("crop_id", "class")).select("run_id", "crop_id", "label", "class", "reason")


# ---- groups of photos


@query(f"""with {PHOTOS}, v as (select *, dense_rank() over (partition by cell order by viewpoint) as v from pn), n as (select *, row_number() over (partition by cell, viewpoint order by name, photo_id) as place from v where v <= 2)
select a.cell, a.place::int as place, a.photo_id as left_item, b.photo_id as right_item from n a join n b on a.cell = b.cell and a.place = b.place and a.v = 1 and b.v = 2""")
def guessed_pairs(spark, d):
    """Photos at the same place of a cell's two viewpoints."""
    return grouping.guessed_pairs(photos(spark, d), "cell", "viewpoint", ["name", "photo_id"], "photo_id")


_TAGGED = f"""tagged as (select distinct photo_id from pn join (select distinct {plain('path')} as path from (select unnest(m) as path from (select unnest(member_groups) as m from tag_pairs))) using (path) where photo_id is not null)"""


@query(f"""with {PHOTOS}, {_TAGGED}, v as (select *, dense_rank() over (partition by cell order by viewpoint) as v from pn), n as (select *, row_number() over (partition by cell, viewpoint order by name, photo_id) as place from v where v <= 2)
select a.cell, a.place::int as place, a.photo_id as left_item, b.photo_id as right_item from n a join n b on a.cell = b.cell and a.place = b.place and a.v = 1 and b.v = 2
where a.photo_id not in (select photo_id from tagged) and b.photo_id not in (select photo_id from tagged)""")
def guessed_pairs_untagged(spark, d):
    """Photos at the same place of a cell's two viewpoints, without those that a hand-made set already holds."""
    p = photos(spark, d)
    tagged = p.join(_tag_sets(spark, d).select(F.explode("members").alias("path")).distinct(), "path").select("photo_id").distinct()
    return grouping.guessed_pairs(p, "cell", "viewpoint", ["name", "photo_id"], "photo_id", tagged)


@query(f"""with {PHOTOS}, n as (select *, row_number() over (partition by cell, viewpoint order by name, photo_id) as place from pn)
select a.cell, a.place::int as place, a.photo_id as left_item, b.photo_id as right_item from n a join n b on a.cell = b.cell and a.place = b.place and a.viewpoint = 'V2' and b.viewpoint = 'V2.1'""")
def positional_pairs(spark, d):
    p = photos(spark, d)
    return joins.positional_pairs(p.where("viewpoint = 'V2'"), p.where("viewpoint = 'V2.1'"), ["cell"], ["name", "photo_id"], "photo_id")


@query(f"with {PHOTOS} select cell, number, string_agg(distinct photo_id::varchar, ',' order by photo_id::varchar) as members from pn where number is not null group by 1, 2 having count(distinct photo_id) > 1")
def hint_groups(spark, d):
    g = grouping.hint_groups(photos(spark, d).withColumn("id", F.col("photo_id").cast("string")), "cell", "number", "id")
    return g.withColumn("members", F.array_join("members", ","))


@query(f"with {PHOTOS} select cell, number, min(photo_id) as first_item, max(photo_id) as second_item from pn where number is not null group by 1, 2 having count(*) = 2")
def reference_pairs(spark, d):
    return joins.reference_pairs(photos(spark, d).where("number is not null"), ["cell", "number"], "photo_id")


@query("select s.split, c.class, p.package from (select unnest(['train', 'val', 'test']) as split) s cross join (select unnest(['normal', 'excess', 'insufficient', 'spike']) as class) c cross join (select distinct package from targets where package is not null) p")
def option_grid(spark, d):
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    packages = table(spark, d, "targets").where("package is not null").select("package").distinct()
    return joins.option_grid([packages, one("split", splits.SPLITS), one("class", labels.CLASSES)])


_WORDS = " + ".join(f"bit_count(xor(('0x' || substr(a.print, {i * 8 + 1}, 8))::bigint, ('0x' || substr(b.print, {i * 8 + 1}, 8))::bigint))::int" for i in range(8))
_HAMMING = f"{PHOTOS}, hp as (select * from (select a.cell, a.photo_id as item_a, b.photo_id as item_b, {_WORDS} as distance from pn a join pn b on a.cell = b.cell and a.photo_id < b.photo_id and a.print is not null and b.print is not null) where distance <= 15)"


@query(f"with {_HAMMING} select * from hp")
def hamming_pairs(spark, d):
    """Photos of one cell whose fingerprints differ in at most 15 bits."""
    return similarity.hamming_pairs(photos(spark, d), ["cell"], "photo_id", "print", 15)


@query("""with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
n as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as z from v)
select a.label, a.vec_id as item_a, b.vec_id as item_b, round(list_inner_product(a.e, b.e) / (greatest(a.z, 1e-12) * greatest(b.z, 1e-12)), 9) as similarity from n a join n b on a.label = b.label and a.vec_id < b.vec_id
where list_inner_product(a.e, b.e) / (greatest(a.z, 1e-12) * greatest(b.z, 1e-12)) >= 0.3""")
def cosine_pairs(spark, d):
    return similarity.cosine_pairs(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 9))


_SETS = f"""sets as (select list_sort(list_distinct(list_transform(unnest(member_groups), lambda x: {plain('x')}))) as m from tag_pairs),
h as (select distinct m[1] as a, unnest(m) as b from sets where len(m) > 1), hop as (select a, b from h union select b, a from h),
reach(a, b) as (select a, b from hop union select r.a, hop.b from reach r join hop on r.b = hop.a), roots as (select a as node, min(least(a, b)) as root from reach group by 1)"""


def _tag_sets(spark, d):
    return table(spark, d, "tag_pairs").select(F.explode("member_groups").alias("m")).select(F.transform("m", paths.plain_path).alias("members"))


@query(f"with recursive {_SETS} select node, root from roots")
def tagged_components(spark, d):
    """Components of photos that share a hand-made set."""
    s = _tag_sets(spark, d).select(F.array_sort(F.array_distinct("members")).alias("m")).where("size(m) > 1")
    return components.connected_components(s.select(F.get("m", F.lit(0)).alias("a"), F.explode("m").alias("b")))


@query(f"with recursive {_SETS} select root, string_agg(node, '|' order by node) as members from roots group by 1 having count(*) > 1")
def canonical_groups(spark, d):
    return grouping.canonical_groups(_tag_sets(spark, d), "members").withColumn("members", F.array_join("members", "|"))


@query(f"with {PHOTOS}, u as (select unnest(member_groups) as m from tag_pairs), s as (select distinct {plain('path')} as path from (select unnest(m) as path from u)) select path from s where path not in (select path from pn)")
def unknown_members(spark, d):
    return grouping.unknown_members(_tag_sets(spark, d), photos(spark, d), "path")


@query(f"""with {PHOTOS}, u as (select unnest(member_groups) as m from tag_pairs), s as (select distinct {plain('path')} as path from (select unnest(m) as path from u)),
v as (select cell, viewpoint, count(*) as n, count(s.path) as t from pn left join s using (path) group by 1, 2)
select cell, sum(n)::bigint as items, min(n) = max(n) as balanced, (2 * (sum(n) - max(n)))::bigint as pairable, sum(t)::bigint as tagged,
case when sum(n) > max(n) then (sum(t) * 100)::double / (2 * (sum(n) - max(n))) else 0 end as percent from v group by 1""")
def tag_progress(spark, d):
    tagged = _tag_sets(spark, d).select(F.explode("members").alias("path"))
    return grouping.tag_progress(photos(spark, d), "cell", "viewpoint", "path", tagged)


@query(f"""with {PHOTOS}, r as (select *, case when number is null then path else min(path) over (partition by cell, number) end as root from (select distinct path, cell, number from pn)),
g as (select root, min(path) as first, count(*) as n from r group by 1), k as (select root, n, row_number() over (order by first) as i from g)
select path, 'hint_' || case when length(i::varchar) < 3 then lpad(i::varchar, 3, '0') else i::varchar end as group_id, n as group_size from r join k using (root)""")
def numbered_groups(spark, d):
    """Photos of one cell and component number as one group, groups numbered by their smallest path."""
    p = photos(spark, d).select("path", "cell", "number").distinct()
    hub = p.where("number is not null").groupBy("cell", "number").agg(F.min("path").alias("item_a"))
    pairs = p.join(hub, ["cell", "number"]).select("item_a", F.col("path").alias("item_b"))
    return grouping.group_ids(grouping.with_components(p, "path", pairs), "root", "path", "hint").select("path", "group_id", "group_size")


_MEASURE = """per as (select {by} g, count(*) as n, count(distinct cell) as cells, sum((viewpoint = 'V2')::int) as a, sum((viewpoint = 'V2.1')::int) as b from items group by all),
tot as (select {by} sum(n)::bigint as items, count(*) as groups, max(n) as largest, sum((n = 1)::int)::bigint as singletons, sum((cells > 1)::int)::bigint as violations, sum(case when a > 0 and b > 0 then a + b else 0 end)::bigint as partnered from per group by all),
ref as (select {by} cell, number, count(distinct g) as k from items where number is not null group by all having count(*) = 2), refs as (select {by} count(*) as "references", sum((k = 1)::int)::bigint as merged from ref group by all),
lit as (select {by} cell, sum((viewpoint = 'V2')::int) as x, sum((viewpoint = 'V2.1')::int) as y from items group by all),
lits as (select {by} sum(2 * least(x, y))::bigint as ceiling, sum(case when x > 0 and y > 0 then x + y else 0 end)::bigint as cross_lit from lit group by all)"""


@query(f"""with {PHOTOS}, items as (select *, coalesce(group_id, path) as g from pn), {_MEASURE.replace('{by}', '')}
select tot.*, "references", merged, ceiling, cross_lit, case when cross_lit > 0 then partnered::double / cross_lit else 0 end as partner_rate from tot cross join refs cross join lits""")
def group_measures(spark, d):
    """Sizes, violations, merged reference pairs and partner rate of the stored grouping."""
    p = photos(spark, d).withColumn("g", F.coalesce("group_id", "path"))
    return grouping.measured(p, ["g"], "cell", "viewpoint", "number")


@query(f"""with recursive {_HAMMING}, t as (select unnest([2.0, 6.0, 10.0, 15.0])::double as threshold),
hop as (select threshold, item_a as a, item_b as b from hp join t on distance <= threshold union select threshold, item_b, item_a from hp join t on distance <= threshold),
reach(threshold, a, b) as (select * from hop union select r.threshold, r.a, h.b from reach r join hop h on h.threshold = r.threshold and h.a = r.b),
root as (select threshold, a as photo_id, min(least(a, b)) as root from reach group by 1, 2),
items as (select t.threshold, pn.*, coalesce(root, pn.photo_id) as g from pn cross join t left join root on root.threshold = t.threshold and root.photo_id = pn.photo_id), {_MEASURE.replace('{by}', 'threshold,')}
select tot.*, coalesce("references", 0) as "references", coalesce(merged, 0) as merged, ceiling, cross_lit, case when cross_lit > 0 then partnered::double / cross_lit else 0 end as partner_rate
from tot left join refs using (threshold) left join lits using (threshold)""")
def grouping_sweep(spark, d):
    """Measures of grouping by fingerprints at several thresholds; pairs are scored once."""
    p = photos(spark, d)
    pairs = written(similarity.hamming_pairs(p, ["cell"], "photo_id", "print", 15), "pairs")
    swept = grouping.threshold_sweep(p, "photo_id", pairs, "distance", [2.0, 6.0, 10.0, 15.0], below=True)
    return grouping.measured(swept, ["root"], "cell", "viewpoint", "number", ["threshold"])


#: The thresholds the reference's report sweeps, in bits of 256.
PHASH_SWEEP = [0.0, 20.0, 40.0, 60.0, 80.0, 85.0, 90.0, 95.0, 100.0, 105.0, 110.0, 120.0, 140.0, 160.0]
_HAMMING_WHOLE = _HAMMING.replace("distance <= 15", "distance <= 160")


@query(f"""with recursive {_HAMMING_WHOLE}, t as (select unnest({PHASH_SWEEP})::double as threshold),
hop as (select threshold, item_a as a, item_b as b from hp join t on distance <= threshold union select threshold, item_b, item_a from hp join t on distance <= threshold),
reach(threshold, a, b) as (select * from hop union select r.threshold, r.a, h.b from reach r join hop h on h.threshold = r.threshold and h.a = r.b),
root as (select threshold, a as photo_id, min(least(a, b)) as root from reach group by 1, 2),
items as (select t.threshold, pn.*, coalesce(root, pn.photo_id) as g from pn cross join t left join root on root.threshold = t.threshold and root.photo_id = pn.photo_id), {_MEASURE.replace('{by}', 'threshold,')}
select tot.*, coalesce("references", 0) as "references", coalesce(merged, 0) as merged, ceiling, cross_lit, case when cross_lit > 0 then partnered::double / cross_lit else 0 end as partner_rate
from tot left join refs using (threshold) left join lits using (threshold)""")
def grouping_sweep_whole(spark, d):
    """Measures of grouping by fingerprints at the reference's fourteen thresholds; all photos of a cell are compared once."""
    p = photos(spark, d)
    pairs = written(similarity.hamming_forest(p, ["cell"], "photo_id", "print", int(max(PHASH_SWEEP))), "pairs")
    swept = grouping.threshold_sweep(p, "photo_id", pairs, "distance", PHASH_SWEEP, below=True)
    return grouping.measured(swept, ["root"], "cell", "viewpoint", "number", ["threshold"])


@query(f"with {PHOTOS}, s as (select group_id, count(*) as size from pn where group_id is not null group by 1) select size, count(*) as groups from s group by 1")
def size_histogram(spark, d):
    return grouping.size_histogram(photos(spark, d).where("group_id is not null"), "group_id")


@query(f"with {PHOTOS} select group_id, count(distinct cell) as cells from pn where group_id is not null group by 1 having count(distinct cell) > 1")
def spanning_groups(spark, d):
    return grouping.spanning(photos(spark, d).where("group_id is not null"), "group_id", "cell")


@query(f"""with {PHOTOS}, s as (select cell, sum((viewpoint = 'V2')::int)::bigint as first, sum((viewpoint = 'V2.1')::int)::bigint as second from pn group by 1)
select cell, first, second, 2 * least(first, second) as most from s where first > 0 and second > 0""")
def partner_ceiling(spark, d):
    return grouping.partner_ceiling(photos(spark, d), "cell", "viewpoint")


@query("select event_id, (props::json ->> 'k')::bigint as k from events")
def json_fields(spark, d):
    """Typed field of a JSON column."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select seed, choice_index, coalesce(nullif(list_aggregate(list_sort(list_transform(map_entries(rejections), lambda e: e.key || '=' || e.value)), 'string_agg', ', '), ''), '(none)') as option from choices")
def rejection_labels(spark, d):
    m = F.transform_values("rejections", lambda _, v: v.cast("string"))
    return table(spark, d, "choices").select("seed", "choice_index", labels.option_label(m).alias("option"))


@query(f"with {PHOTOS} select distinct path, array_to_string(list_slice(string_split(regexp_replace(regexp_replace(stem, '_C\\d+$', ''), '_Pro$', ''), '_'), -3, -1), '_') || case when number is null then '' else ' C' || number end as label from pn")
def short_labels(spark, d):
    p = photos(spark, d).select("path", paths.short_label("stem", F.concat(F.lit("C"), "number")).alias("label"))
    return p.distinct()
