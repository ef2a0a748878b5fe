"""More queries of the reference's operators, each beside its SQL: sources and sinks as round trips, guards, hand-made groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jointmill.functions import geometry, labels, paths
from jointmill.operators import components, grouping, inventory, joins, metrics, polygons, sampling, similarity, splits, windows
from jointmill.plans import reports
from jointmill.plans.core_queries import _HAMMING, _MEASURE, _SETS, _SWEEP, FRAME, _sweep, _tag_sets, crops, photos, records, scored
from jointmill.plans.sql import CROPS, PHOTOS, RECORDS, SCORES, plain
from jointmill.session import run_dir, table, written
from jointmill.sources import annotations as ann
from jointmill.sources import tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


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


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks: what is written is what is read

_SHAPES = f"{RECORDS}, known as (select * from rec where class is not null and raw_label is not null and raw_label <> '' and len(points) > 0)"


def _annotated(spark: SparkSession, d: str, layout: str) -> DataFrame:
    """(path, text): annotation JSON of every photo with labelled records, in the given layout."""
    r = records(spark, d).where("class is not null and raw_label is not null and raw_label <> '' and size(points) > 0")
    shape = F.struct("record_id", F.struct(F.col("raw_label").alias("label"), "points").alias("s"))
    p = r.groupBy("dataset_path").agg(F.transform(F.array_sort(F.collect_list(shape)), lambda x: x["s"]).alias("shapes"))
    record = F.struct(F.col("dataset_path").alias("imagePath"), F.lit(FRAME[0]).alias("imageWidth"), F.lit(FRAME[1]).alias("imageHeight"), F.lit("AAAA").alias("imageData"), "shapes")
    whole = {"record": record, "list": F.array(record), "mapping": F.create_map("dataset_path", record)}[layout]
    return p.select(F.concat("dataset_path", F.lit(".json")).alias("path"), ann.without_image_data(F.to_json(whole)).alias("text"))


_PARSED = f"""with {_SHAPES} select dataset_path || '.json' as source, '{{layout}}' as layout, regexp_replace(dataset_path, '^.*/', '') as image_name, 2560 as width, 1440 as height,
count(*) as shapes, sum(len(points))::bigint as vertices, count(distinct raw_label) as labels from known group by 1, 3"""


def _parsed(spark: SparkSession, d: str, layout: str) -> DataFrame:
    a = ann.annotations(_annotated(spark, d, layout))
    vertices = F.aggregate("shapes", F.lit(0).cast("long"), lambda n, s: n + F.size(s["points"]))
    return a.groupBy("source", "layout", "image_name", "width", "height").agg(F.sum(F.size("shapes")).cast("long").alias("shapes"), F.sum(vertices).alias("vertices"), F.max(F.size(F.map_keys("labels"))).cast("long").alias("labels"))


@query(_PARSED.format(layout="record"))
def parsed_records(spark, d):
    """Annotation files of one record each, written as JSON from the polygons and parsed back."""
    return _parsed(spark, d, "record")


@query(_PARSED.format(layout="list"))
def parsed_lists(spark, d):
    return _parsed(spark, d, "list")


@query(_PARSED.format(layout="mapping"))
def parsed_mappings(spark, d):
    return _parsed(spark, d, "mapping")


@query(f"with {_SHAPES} select dataset_path || '.json' as source, regexp_replace(dataset_path, '^.*/', '') as image_name, raw_label as label, count(*) as n from known group by 1, 2, 3")
def parsed_coco(spark, d):
    """The same in the layout of images, annotations and categories: labels of every image, counted."""
    t = _annotated(spark, d, "record").select("path", F.from_json("text", ann._RECORD).alias("r"))
    names = F.array_sort(F.array_distinct("r.shapes.label"))
    images = F.array(F.struct(F.lit(1).alias("id"), F.col("r.imagePath").alias("file_name"), F.col("r.imageWidth").alias("width"), F.col("r.imageHeight").alias("height")))
    kinds = F.transform(names, lambda x, i: F.struct(i.alias("id"), x.alias("name")))
    marks = F.transform("r.shapes", lambda s: F.struct(F.lit(1).alias("image_id"), (F.array_position(names, s["label"]) - 1).alias("category_id")))
    coco = t.select("path", F.to_json(F.struct(images.alias("images"), marks.alias("annotations"), kinds.alias("categories"))).alias("text"))
    return ann.annotations(coco).select("source", "image_name", F.explode("labels").alias("label", "n"))


@query(f"""with {RECORDS}, known as (select * from rec where raw_label in ('good', 'exc_solder', 'poor_solder', 'spike') and len(points) > 0 and regexp_matches(dataset_path, '/V2(\\.1)?/')),
v as (select *, list_sum(list_transform(points, lambda p: p[1])) / len(points) as x, row_number() over (partition by dataset_path order by record_id) - 1 as pos from known)
select dataset_path, raw_label, case raw_label when 'good' then 'normal' when 'exc_solder' then 'excess' when 'poor_solder' then 'insufficient' else 'spike' end as class, (count(*) over (partition by dataset_path))::int as polygon_count,
(row_number() over (partition by dataset_path order by x, pos))::int as polygon_rank_x from v""")
def flattened(spark, d):
    """One row a shape of joint photos, with class, count and rank from left to right."""
    r = records(spark, d).where(F.col("raw_label").isin(*labels.RAW_TO_CLASS) & (F.size("points") > 0) & F.col("dataset_path").rlike(r"/V2(\.1)?/"))
    shape = F.struct("record_id", F.struct(F.col("raw_label").alias("label"), "points").alias("s"))
    a = r.groupBy("dataset_path").agg(F.min("image_name").alias("image_name"), F.transform(F.array_sort(F.collect_list(shape)), lambda x: x["s"]).alias("shapes"))
    return polygons.flattened(a).select("dataset_path", "raw_label", "class", "polygon_count", "polygon_rank_x")


_POLYGON_ROWS = f"{RECORDS}, rows as (select * from box where class is not null)"


@query(f"with {_POLYGON_ROWS} select dataset_path, class, coalesce(merged_from, '') as merged_from, count(*) as n, sum(len(points))::bigint as vertices, round(sum(bx0), 6) as left_edges from rows group by 1, 2, 3")
def stored_polygons(spark, d):
    """Polygons written as CSV, points as JSON text, and read back with their schema."""
    r = windows.positions(records(spark, d).where("class is not null"), ["dataset_path"], "bx0", "record_id").withColumn("capture_timestamp", F.lit(""))
    names = [f.split()[0] for f in tables.POLYGONS.split(", ")]
    path = _place(spark, "polygons")
    tables.write_csv(r.select(*names), path)
    p = tables.read_polygons(spark, path).withColumn("b", geometry.bbox("points"))
    return p.groupBy("dataset_path", "class", "merged_from").agg(F.count("*").alias("n"), F.sum(F.size("points")).alias("vertices"), F.round(F.sum("b.x0"), 6).alias("left_edges"))


_HINTED = f"""{PHOTOS}, r as (select *, case when number is null then path else min(path) over (partition by cell, number) end as root from (select distinct path, name, board, package, viewpoint, cell, number from pn where cell is not null)),
g as (select root, min(path) as first, count(*) as n from r group by 1), k as (select root, n, row_number() over (order by first) as i from g)"""


def _hinted(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).where("cell is not null").select(F.col("name").alias("image_name"), F.col("path").alias("dataset_path"), "board", "package", "viewpoint", "cell", F.col("number").alias("component_hint")).distinct()
    hub = p.where("component_hint is not null").groupBy("cell", "component_hint").agg(F.min("dataset_path").alias("root"))
    rooted = p.join(hub, ["cell", "component_hint"], "left").withColumn("root", F.coalesce("root", "dataset_path"))
    return grouping.group_rows(grouping.group_ids(rooted, "root", "dataset_path", "hint"), "hint", 10.0, 0.1)


@query(f"""with {_HINTED} select name as image_name, path as dataset_path, board, package, cell, viewpoint, coalesce(number, '') as component_hint, 'hint' as method, '10' as threshold, '0.1' as crop_tolerance, '' as fingerprint,
'hint_' || case when length(i::varchar) < 3 then lpad(i::varchar, 3, '0') else i::varchar end as group_id, n as group_size from r join k using (root)""")
def group_rows(spark, d):
    """Grouped photos in the thirteen columns that every grouping method writes."""
    return _hinted(spark, d)


@query(f"""with {_HINTED} select path as dataset_path, max('hint_' || case when length(i::varchar) < 3 then lpad(i::varchar, 3, '0') else i::varchar end) as group_id from r join k using (root) group by 1""")
def stored_groups(spark, d):
    """The table of groups written as CSV and read back as path and group."""
    path = _place(spark, "groups")
    tables.write_csv(_hinted(spark, d), path)
    return tables.read_groups(spark, path)


_FROZEN = f"{CROPS}, fr as (select * from cr where class is not null and split is not null)"


def _frozen(spark: SparkSession, d: str) -> DataFrame:
    c = crops(spark, d).where("class is not null and split is not null")
    return c.select("crop_id", F.substring_index("crop_id", "#", 1).alias("dataset_path"), F.substring_index("crop_id", "#", -1).alias("polygon_rank_x"), F.lit("").alias("joint_position"), "board", "package", F.concat_ws("/", "board", "package").alias("cell"), F.lit("").alias("viewpoint"), "class", "group_id", "split", F.lit("-").alias("split_hash"))


@query(f"with {_FROZEN} select crop_id, group_id, split from fr")
def stored_splits(spark, d):
    """The table of a frozen split written as CSV and read back: its columns are there, its crops unique."""
    path = _place(spark, "splits")
    tables.write_csv(_frozen(spark, d), path)
    return tables.read_splits(spark, path)


@query(f"with {_FROZEN} select crop_id, class as label, 'val' as split, 'crops/' || crop_id || '.png' as path from fr where split = 'val'")
def stored_crop_set(spark, d):
    """A manifest written as CSV, of which the crops of one split are read with their files."""
    path = _place(spark, "manifest")
    tables.write_csv(_frozen(spark, d).withColumnRenamed("class", "label"), path)
    return tables.read_crop_set(spark, path, "val", "crops").select("crop_id", "label", "split", "path")


@query(f"with recursive {_SETS}, g as (select root, list_sort(list(node)) as m from roots group by 1 having count(*) > 1) select array_to_string(m, '|') as members from g")
def stored_pairs(spark, d):
    """Hand-made groups written as JSON and read back."""
    path = _place(spark, "pairs")
    tables.write_pairs(components.connected_components(grouping.set_edges(_tag_sets(spark, d), "members")), path)
    return tables.read_pairs(spark, path, lines=True).select(F.array_join("members", "|").alias("members"))


@query(f"with {_SWEEP} select printf('%.6f', threshold) as threshold, printf('%.6f', miss) as miss, printf('%.6f', far) as far from sw where run_id = 'run_baseline'")
def stored_sweep(spark, d):
    """The sweep of the largest run written as CSV, to six decimals, and read back as text."""
    path = _place(spark, "sweep")
    tables.write_sweep(_sweep(spark, d).where("run_id = 'run_baseline'"), path)
    return spark.read.option("header", "true").csv(path)


@query("select distinct run_id, crop_id, label, array_to_string(logits, ' ') as logits from (select run_id, crop_id, label, list_transform(logits, lambda x: printf('%.5f', x + 0)) as logits from predictions)")
def stored_predictions(spark, d):
    """Predictions written as Parquet and read back with the logits."""
    p = table(spark, d, "predictions").select("run_id", "crop_id", "label", "logits").distinct()
    kept = written(p, "predictions")
    return kept.select("run_id", "crop_id", "label", F.array_join(F.transform("logits", lambda x: F.format_string("%.5f", x.cast("double") + 0.0)), " ").alias("logits")).distinct()


# ---- inventory


@query(f"""with {PHOTOS}, e as (select distinct path, lower(coalesce(nullif(regexp_extract(name, '.(\\.[^.]*)$', 1), ''), '')) as ext from pn) select ext, ext in ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.webp') as is_image, count(*) as n from e group by 1, 2""")
def extensions(spark, d):
    """Files by extension, and whether they are photos."""
    return inventory.value_counts(inventory.described(photos(spark, d).select("path").distinct()), ["ext", "is_image"])


_FOLDERS = """s as (select path, name, string_split(folder, '/') as s, list_position(list_transform(string_split(folder, '/'), lambda p: regexp_matches(p, '^V\\d+(\\.\\d+)?$')), true) as pos from (select distinct path, name, folder from pn)),
f as (select path, name, case when pos > 2 then s[pos - 2] end as board, case when pos > 1 then s[pos - 1] end as package, case when pos > 0 then s[pos] end as viewpoint, case when pos > 0 and regexp_matches(s[pos + 1], '^Setup\\d+$') then s[pos + 1] end as setup from s),
v as (select *, viewpoint || coalesce('/' || setup, '') as part from f)"""


def _described(spark: SparkSession, d: str) -> DataFrame:
    return inventory.described(photos(spark, d).select("path").distinct())


@query(f"""with {PHOTOS}, {_FOLDERS}, n as (select board, package, part, count(*) as n from v where board is not null and package is not null and part is not null group by 1, 2, 3)
select board, package, package in ('R0603', 'R0805', 'R1206', 'C0805') as in_scope, string_agg(part || '=' || n, ', ' order by part) as counts, min(n) < max(n) as ragged from n group by 1, 2""")
def cell_table(spark, d):
    """Photos of every cell by viewpoint folder, setups apart."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    return inventory.cell_table(_described(spark, d)).select("board", "package", "in_scope", text.alias("counts"), "ragged")


@query(f"with {PHOTOS}, {_FOLDERS} select path from v where board is null or package is null or part is null")
def unclassified_photos(spark, d):
    return inventory.unclassified(_described(spark, d)).select("path")


@query(f"with {PHOTOS}, {_FOLDERS} select path, name from v where board = 'CS1' and package = 'R0805' and viewpoint = 'V2'")
def selected_cell(spark, d):
    """The photos of one cell and viewpoint."""
    return inventory.select_cell(_described(spark, d), "CS1", "R0805", "V2").select("path", "name")


@query(f"""with {PHOTOS}, {RECORDS.strip()}, w as (select distinct image_name as wanted from rec union select distinct dataset_path from rec), f as (select distinct path, name from pn),
n as (select name, count(*) as n, min(path) as one from f group by 1)
select w.wanted, coalesce(f.path, case when n.n = 1 then one end) as path, case when f.path is not null then 'path' when n.n = 1 then 'name' when n.n > 1 then 'ambiguous' else 'none' end as how
from w left join f on f.path = w.wanted left join n on n.name = w.wanted""")
def found_paths(spark, d):
    """Which photo a path or a bare name means."""
    r = records(spark, d)
    wanted = r.select(F.col("image_name").alias("wanted")).union(r.select("dataset_path"))
    return inventory.found_paths(wanted, photos(spark, d))


_RESOLVED = f"""{PHOTOS}, {RECORDS.strip()}, a as (select distinct image_name as name, coalesce(nullif(regexp_extract(dataset_path, '^(.*)/[^/]*$', 1), ''), '.') as own from rec),
f as (select distinct name, folder, path from pn), j as (select a.name, own, f.path, f.folder, f.folder <> own as outside from a left join f on f.name = a.name),
r as (select *, row_number() over (partition by name, own order by outside desc, string_split(path, '/')) as k, count(path) over (partition by name, own, outside) as n from j), one as (select * from r where k = 1)"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    a = records(spark, d).select(F.col("image_name").alias("name"), paths.folder("dataset_path").alias("own")).distinct()
    return joins.resolve_prefer_elsewhere(a, photos(spark, d).select("name", "folder", "path").distinct(), "name", "own")


@query(f"with {_RESOLVED} select folder, count(*) as n from one where path is not null group by 1")
def annotation_locations(spark, d):
    """Where annotated photos are, by folder."""
    return inventory.value_counts(_resolved(spark, d).where("resolved_path is not null").select(paths.folder("resolved_path").alias("folder")), ["folder"])


@query(f"with {_RESOLVED} select distinct name, case when path is null then 'missing' else 'ambiguous' end as reason from one where path is null or n > 1")
def annotation_gaps(spark, d):
    """Annotations that several photos answer to, or none."""
    return inventory.annotation_gaps(_resolved(spark, d))


@query(f"""with {_RESOLVED}, s as (select name, string_split(coalesce(folder, ''), '/') as s from one), v as (select name, list_filter(s, lambda p: regexp_matches(p, '^V\\d+(\\.\\d+)?$'))[1] as v from s)
select coalesce(case v when 'V1' then 'placement' when 'V2' then 'joint' when 'V2.1' then 'joint' end, 'unclassified') as task, count(*) as n from v group by 1""")
def annotations_by_task(spark, d):
    """Annotated photos by task; those without a place or a task are unclassified."""
    found = inventory.described(_resolved(spark, d).withColumnRenamed("name", "said"), "resolved_path")
    return inventory.value_counts(inventory.by_task(found, "said"), ["task"])


# ---- splits, samples, crops


@query(f"with {CROPS} select distinct class from cr where class <> 'normal'")
def defect_classes(spark, d):
    return splits.defect_classes(crops(spark, d), "class")


@query(f"with {CROPS} select s.split, count(distinct group_id) as groups from (select unnest(['train', 'val', 'test']) as split) s left join cr on cr.split = s.split group by 1")
def group_counts(spark, d):
    return splits.group_counts(crops(spark, d), "split", "group_id")


@query(f"""with {CROPS}, k as (select * from cr where split is not null and class is not null), l as (select count(*) as found from (select group_id from k where group_id is not null group by 1 having count(distinct split) > 1)),
n as (select s.split, c.class, count(crop_id) as n from (select unnest(['val', 'test']) as split) s cross join (select unnest(['normal', 'excess', 'insufficient', 'spike']) as class) c left join k on k.split = s.split and k.class = c.class group by 1, 2)
select 'G1' as gate, null::varchar as split, null::varchar as class, found, 0 as needed from l where found > 0 union all
select case when class = 'normal' then 'G2' else 'G3' end, split, class, n, case when class = 'normal' then 12 else 8 end from n where n < case when class = 'normal' then 12 else 8 end""")
def failed_gates(spark, d):
    """The gates that the stored split fails: groups in several splits, too few crops of a class."""
    c = crops(spark, d).where("split is not null and class is not null")
    return splits.gate(c, "split", "group_id", "class")


@query(f"with {_FROZEN} select c.class as label, count(crop_id) as n from (select unnest(['normal', 'excess', 'insufficient', 'spike']) as class) c left join fr on fr.class = c.class and fr.split = 'train' group by 1")
def train_class_counts(spark, d):
    """Crops of every class in one split; unknown labels and an empty split are refused."""
    return splits.class_counts_of(crops(spark, d).where("class is not null").withColumnRenamed("class", "label"), "train")


@query(f"""with {RECORDS}, {CROPS.strip()}, r as (select *, row_number() over (partition by dataset_path order by (bx0 + bx1) / 2, record_id) as k from box where class is not null),
j as (select r.*, cr.split from r join cr on cr.crop_id = r.dataset_path || '#' || r.k where cr.split is not null),
e as (select *, bx0 - (bx1 - bx0) * 0.1::double as x0, by0 - (by1 - by0) * 0.1::double as y0, bx1 + (bx1 - bx0) * 0.1::double as x1, by1 + (by1 - by0) * 0.1::double as y1 from j),
q as (select class, split, merged_from, case when x1 - x0 >= y1 - y0 then x0 else (x0 + x1) / 2 - (y1 - y0) / 2 end as x0, case when x1 - x0 >= y1 - y0 then (y0 + y1) / 2 - (x1 - x0) / 2 else y0 end as y0,
  case when x1 - x0 >= y1 - y0 then x1 else (x0 + x1) / 2 + (y1 - y0) / 2 end as x1, case when x1 - x0 >= y1 - y0 then (y0 + y1) / 2 + (x1 - x0) / 2 else y1 end as y1 from e),
s as (select *, greatest(ceil(x1) - floor(x0), ceil(y1) - floor(y0)) as side from q)
select count(*) as crops, sum((coalesce(merged_from, '') <> '')::int)::bigint as merged, sum((split = 'train')::int)::bigint as train, sum((split = 'val')::int)::bigint as val, sum((split = 'test')::int)::bigint as test,
sum((class = 'normal')::int)::bigint as normal, sum((class = 'excess')::int)::bigint as excess, sum((class = 'insufficient')::int)::bigint as insufficient, sum((class = 'spike')::int)::bigint as spike,
trunc(median(least(side, 2560)))::int as median_crop_w, trunc(median(least(side, 1440)))::int as median_crop_h from s""")
def crop_summary(spark, d):
    """One row on a run of crops: how many, by split and class, how many merged, and their median size."""
    r = windows.positions(records(spark, d).where("class is not null"), ["dataset_path"], (F.col("bx0") + F.col("bx1")) / 2, "record_id")
    m = polygons.manifest(r, crops(spark, d).where("split is not null"), 0.1, *FRAME)
    merged = r.select(paths.file_safe_id("board", "package", "viewpoint", "dataset_path", "polygon_rank_x").alias("crop_id"), F.col("dataset_path").alias("source_path"), "merged_from")
    return splits.crop_summary(m.join(merged, ["crop_id", "source_path"], "left"))


@query(f"with {CROPS} select class, crop_id from cr where class is not null and split = 'train' qualify row_number() over (partition by class order by md5('11:' || crop_id), crop_id) <= 64")
def contact_sheets(spark, d):
    """Up to 64 train crops a class, as they go on contact sheets: the sample is the feature."""
    c = crops(spark, d).where("class is not null and split = 'train'").select("class", "crop_id")
    return sampling.seeded_sample(c, "crop_id", 64, 11, ["class"])


@query(f"""with {CROPS}, s as (select class, crop_id, row_number() over (partition by class order by crop_id) - 1 as i from (select * from cr where class is not null and split = 'train' qualify row_number() over (partition by class order by md5('11:' || crop_id), crop_id) <= 64))
select class, crop_id, (i // 24 + 1)::int as sheet, (i % 24 + 1)::int as tile from s""")
def sheet_tiles(spark, d):
    """Sheet and tile of every crop of the contact sheets, in the order of their ids."""
    return reports.sheets(contact_sheets(spark, d), ["crop_id"], 24, ["class"])


@query(f"""with {RECORDS}, p as (select dataset_path, count(*) as n from rec group by 1), few as (select dataset_path, 'sampled' as why from p order by md5('3:' || dataset_path), dataset_path limit 12)
select * from few union all select dataset_path, 'three' from p where n = 3""")
def reviewed_photos(spark, d):
    """Photos whose outlines are drawn for review: a seeded dozen, and all with three records. The sample is the feature."""
    p = records(spark, d).groupBy("dataset_path").agg(F.count("*").alias("n"))
    few = sampling.seeded_sample(p, "dataset_path", 12, 3).select("dataset_path", F.lit("sampled").alias("why"))
    return few.unionByName(p.where("n = 3").select("dataset_path", F.lit("three").alias("why")))


@query(f"with {RECORDS}, v as (select record_id, unnest(points) as p, generate_subscripts(points, 1) as i from rec) select record_id, i::int as i, round_even(p[1] + 0.5, 0)::int as x, round_even(p[2] + 0.5, 0)::int as y from v")
def drawn_vertices(spark, d):
    """Vertices on whole pixels, halves to the even one; all are moved by half a pixel, as the outlines stand on whole ones."""
    moved = F.transform("points", lambda p: F.transform(p, lambda x: x + 0.5))
    v = records(spark, d).select("record_id", F.posexplode(geometry.int_points(moved)).alias("i", "p"))
    return v.select("record_id", (F.col("i") + 1).alias("i"), F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


# ---- scores


@query(f"""with {SCORES}, v as (select distinct label, pred, score, run_id || '/' || crop_id as item from sc where score is not null and not isnan(score) and pred between 0 and 3 and label between 0 and 1),
r as (select *, row_number() over (partition by label, pred order by case when pred = 0 then score else -score end, item) as place, count(*) over (partition by label, pred) as total from v),
g as (select t.i::int as label, p.i::int as pred from range(4) t(i) cross join range(4) p(i))
select g.label, g.pred, place::int as place, item, score, coalesce(total, 0) as total from g left join (select * from r where place <= 3) r on r.label = g.label and r.pred = g.pred""")
def gallery_cells(spark, d):
    """The three first predictions of each cell, with the cells of two true classes left empty on purpose."""
    v = scored(spark, d).where("score is not null and not isnan(score) and pred between 0 and 3 and label between 0 and 1")
    v = v.select("label", "pred", "score", F.concat("run_id", F.lit("/"), "crop_id").alias("item")).distinct()
    return metrics.dense_gallery(v, "label", "pred", "score", "item", 3)


@query(f"""with {SCORES}, k as (select run_id, package, count(*) filter (where score is not null and not isnan(score) and label is not null) as n, count(*) filter (where score is not null and not isnan(score) and label <> 0) as d
from (select sc.*, split_part(crop_id, '/', 3) as package from sc) group by 1, 2)
select run_id, package, case when n = 0 then 'no scores' when d = 0 then 'no defects' else 'defects only' end as reason from k where n = 0 or d = 0 or d = n""")
def skipped_runs(spark, d):
    """Runs, by package, that no summary can use, and why."""
    p = scored(spark, d).withColumn("package", F.split_part("crop_id", F.lit("/"), F.lit(3)))
    return metrics.unusable(p, "label", "score", ["run_id", "package"])


@query(f"with {_SWEEP} select 0.0::double as far, 0.0::double as hit, null::double as threshold union all select far, 1 - miss, threshold from sw where run_id = 'run_baseline'")
def roc_points(spark, d):
    """The points of the largest run's curve."""
    return reports.roc_points(_sweep(spark, d).where("run_id = 'run_baseline'"))


# ---- hand-made groups


@query(f"""with recursive {_SETS}, {PHOTOS.strip()}, i as (select distinct path, name, board, package, viewpoint, cell, number from pn where cell is not null), m as (select i.*, coalesce(root, path) as g from i left join roots on roots.node = i.path),
k as (select g, count(*) as n, row_number() over (order by min(path)) as i from m group by 1)
select path as dataset_path, 'manual' as method, '' as threshold, '' as crop_tolerance, '' as fingerprint, 'manual_' || case when length(i::varchar) < 3 then lpad(i::varchar, 3, '0') else i::varchar end as group_id, n as group_size from m join k using (g)""")
def manual_rows(spark, d):
    """Photos grouped by hand-made sets, in the columns of every grouping."""
    p = photos(spark, d).where("cell is not null").select(F.col("name").alias("image_name"), F.col("path").alias("dataset_path"), "board", "package", "viewpoint", F.col("number").alias("component_hint")).distinct()
    rows = grouping.manual_rows(p, components.connected_components(grouping.set_edges(_tag_sets(spark, d), "members")))
    return rows.select("dataset_path", "method", "threshold", "crop_tolerance", "fingerprint", "group_id", "group_size")


_GROUPS = f"{_SETS}, big as (select root, count(*) as n from roots group by 1 having count(*) > 1), mem as (select node, roots.root from roots join big on big.root = roots.root), ends as (select min(root) as a, max(root) as z from big)"


def _memberships(spark: SparkSession, d: str) -> DataFrame:
    return written(components.connected_components(grouping.set_edges(_tag_sets(spark, d), "members")), "memberships")


def _listed(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("members")).where(F.size("members") > 1)


@query(f"with recursive {_GROUPS} select node, root from mem where root = (select a from ends)")
def group_of_path(spark, d):
    """The group that holds the first tagged path."""
    m = _memberships(spark, d)
    return grouping.group_of(m, m.agg(F.min("node")).first()[0])


@query(f"with recursive {_GROUPS}, l as (select node, case when root = (select z from ends) then (select a from ends) else root end as root from mem) select root, string_agg(node, '|' order by node) as members from l group by 1")
def linked_groups(spark, d):
    """The groups after the first and the last one were linked."""
    m = _memberships(spark, d)
    a, z = m.agg(F.min("root"), F.max("root")).first()
    return grouping.linked(_listed(m), a, z).withColumn("members", F.array_join("members", "|"))


@query(f"with recursive {_GROUPS}, l as (select node, root as was from mem where node <> (select a from ends)) select min(node) as root, string_agg(node, '|' order by node) as members from l group by was having count(*) > 1")
def unlinked_groups(spark, d):
    """The groups after the first path was taken out of its group."""
    m = _memberships(spark, d)
    return grouping.unlinked(_listed(m), m.agg(F.min("root")).first()[0]).withColumn("members", F.array_join("members", "|"))


@query(f"with recursive {_GROUPS}, f as (select node from mem where root = (select a from ends)) select root, string_agg(node, '|' order by node) as members from mem group by 1 having bool_or(node not in (select node from f))")
def cleared_groups(spark, d):
    """The groups after the paths of the first one were cleared."""
    m = _memberships(spark, d)
    first = [r["node"] for r in grouping.group_of(m, m.agg(F.min("root")).first()[0]).collect()]  # one group that a person made
    return grouping.without_cell(_listed(m), F.array(*map(F.lit, first))).withColumn("members", F.array_join("members", "|"))


@query(f"""with recursive {PHOTOS}, sets as (select list_sort(list_distinct(list_transform(unnest(member_groups), lambda x: {plain('x')}))) as m from tag_pairs),
hints as (select min(path) over (partition by cell, number) as a, path as b, count(*) over (partition by cell, number) as n from (select distinct cell, number, path from pn where number is not null and cell is not null)),
h as (select distinct m[1] as a, unnest(m) as b from sets where len(m) > 1 union select a, b from hints where n > 1), hop as (select a, b from h union select b, a from h),
reach(a, b) as (select a, b from hop union select r.a, hop.b from reach r join hop on r.b = hop.a)
select a as node, min(least(a, b)) as root from reach group by 1""")
def hint_memberships(spark, d):
    """Hand-made groups united with the photos of one cell that carry the same component number."""
    return grouping.pair_by_hint(photos(spark, d).where("cell is not null"), "cell", "number", "path", grouping.set_edges(_tag_sets(spark, d), "members"))


@query(f"with {PHOTOS} select number, count(distinct cell) as cells from pn where number is not null and cell is not null group by 1 having count(distinct cell) > 1")
def spanning_numbers(spark, d):
    """Component numbers that occur in several cells, which is why a number is one component in its cell only."""
    return grouping.spanning(photos(spark, d).where("number is not null and cell is not null"), "number", "cell")


@query(f"""with {PHOTOS}, i as (select distinct cell, viewpoint, path from pn where cell is not null)
select cell, viewpoint, (dense_rank() over (partition by cell order by viewpoint))::int as column, (row_number() over (partition by cell, viewpoint order by path))::int as place, path from i""")
def cell_columns(spark, d):
    """The viewpoints of every cell side by side, photos in the order of their paths."""
    return grouping.cell_columns(photos(spark, d).where("cell is not null").select("cell", "viewpoint", "path").distinct(), "cell", "viewpoint", "path")


@query(f"""with recursive {_SETS}, {PHOTOS.strip()}, i as (select distinct cell, viewpoint, path from pn where cell is not null), k as (select roots.* from roots where node in (select path from i)),
s as (select cell, sum(n) as n, max(n) as m from (select cell, viewpoint, count(*) as n from i group by 1, 2) group by 1), t as (select count(distinct node) as tagged from k),
o as (select (select count(*) from i) as images, (select count(*) from (select root from k group by 1 having count(*) > 1)) as groups, tagged, (select sum(2 * (n - m)) from s)::bigint as pairable, (select count(distinct node) from roots where node not in (select path from i)) as unknown from t)
select images, groups, tagged, images - tagged as untagged, pairable, unknown, case when pairable > 0 then (tagged * 100)::double / pairable else 0 end as percent from o""")
def tag_summary(spark, d):
    """One row on how far hand-made pairing has come."""
    items = photos(spark, d).where("cell is not null").select("cell", "viewpoint", "path").distinct()
    return grouping.tag_summary(items, "cell", "viewpoint", "path", _memberships(spark, d))


@query(f"""with {PHOTOS}, i as (select distinct path, cell from pn where cell is not null), k as (select cell, count(*) as n, row_number() over (order by min(path)) as i from i group by 1)
select path, 'coarse_' || case when length(i::varchar) < 3 then lpad(i::varchar, 3, '0') else i::varchar end as group_id, n as group_size from i join k using (cell)""")
def coarse_groups(spark, d):
    """Photos grouped by cell alone."""
    p = photos(spark, d).where("cell is not null").select("path", "cell").distinct()
    return grouping.group_ids(p, "cell", "path", "coarse").select("path", "group_id", "group_size")


_SMALL = f"""{_HAMMING.replace('distance <= 15', 'distance <= 10')}, t as (select unnest([2.0, 6.0, 10.0])::double as threshold), tol as (select unnest([0.0, 1.0])::double as tolerance),
hop as (select tolerance, threshold, item_a as a, item_b as b from hp join t on true join tol on distance + tolerance <= threshold union select tolerance, threshold, item_b, item_a from hp join t on true join tol on distance + tolerance <= threshold),
reach(tolerance, threshold, a, b) as (select * from hop union select r.tolerance, r.threshold, r.a, h.b from reach r join hop h on h.tolerance = r.tolerance and h.threshold = r.threshold and h.a = r.b),
root as (select tolerance, threshold, a as photo_id, min(least(a, b)) as root from reach group by 1, 2, 3),
items as (select tol.tolerance, t.threshold, pn.*, coalesce(root, pn.photo_id) as g from pn cross join t cross join tol left join root on root.tolerance = tol.tolerance and root.threshold = t.threshold and root.photo_id = pn.photo_id)"""


@query(f"""with recursive {_SMALL}, {_MEASURE.replace('{by}', 'tolerance, threshold,')}
select tolerance, threshold, tot.groups, largest, singletons, violations, coalesce("references", 0) as "references", coalesce(merged, 0) as merged from tot left join refs using (tolerance, threshold)""")
def tolerance_sweep(spark, d):
    """Measures of grouping at several crop tolerances and thresholds. The tables hold one fingerprint a photo, so a
    tolerance of 1 stands for crops that lie a bit further apart."""
    p = photos(spark, d)
    pairs = written(similarity.hamming_pairs(p, ["cell"], "photo_id", "print", 10), "pairs")
    at = lambda t: pairs.withColumn("distance", F.col("distance") + F.lit(t or 0.0))
    swept = grouping.sweep_at_tolerances(p, "photo_id", at, [0.0, 1.0], "distance", [2.0, 6.0, 10.0], below=True)
    return grouping.measured(swept, ["root"], "cell", "viewpoint", "number", ["tolerance", "threshold"]).select("tolerance", "threshold", "groups", "largest", "singletons", "violations", "references", "merged")


@query(f"""with recursive {_SMALL}, {_MEASURE.replace('{by}', 'tolerance, threshold,')}, o as (select tolerance, threshold, largest, coalesce(merged, 0) as merged from tot left join refs using (tolerance, threshold) where tolerance = 0)
select threshold, merged, largest from o order by merged desc, largest, threshold limit 1""")
def best_threshold(spark, d):
    """The threshold that merges most reference pairs, then has the smallest largest group."""
    return grouping.best_row(tolerance_sweep(spark, d).where("tolerance = 0"), "threshold").select("threshold", "merged", "largest")


@query("select vec_id, round(sqrt(list_inner_product(e, e)), 6) as norm, len(e)::int as length from (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings)")
def injected_features(spark, d):
    """Features by a function that the caller gives, here norm and length of the stored vectors, asked in batches."""

    def feature(p):
        return [[float(np.linalg.norm(np.asarray(v, np.float64))), len(v)] for v in p["embedding"]]

    f = similarity.embedded(table(spark, d, "embeddings"), ["vec_id"], ["embedding"], feature)
    return f.select("vec_id", F.round(F.get("vector", F.lit(0)), 6).alias("norm"), F.get("vector", F.lit(1)).cast("int").alias("length"))
