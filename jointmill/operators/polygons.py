"""Records of annotated joints: flattening, photos, box statistics, crops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointmill.functions.geometry import bbox, polygon_area, square_crop
from jointmill.functions.labels import RAW_TO_CLASS
from jointmill.functions.paths import capture_timestamp, component_hint, crop_key, file_safe_id, lookup, stem
from jointmill.operators.inventory import described
from jointmill.operators.joins import guarded_inner
from jointmill.operators.metrics import medians
from jointmill.operators.windows import positions


def flattened(annotations: DataFrame, taxonomy: dict[str, str] | None = None) -> DataFrame:
    """One row a shape of joint photos: path facts, raw label, class, points, count and rank from left to right.

    annotations: dataset_path, image_name, shapes (array of label and points). Photos of other tasks are left out; a label
    that the taxonomy lacks raises when read. Ranks go by the mean x of the vertices, then by place in the file.
    """
    from jointmill.functions.geometry import vertex_mean_x

    taxonomy = taxonomy or RAW_TO_CLASS
    a = described(annotations, "dataset_path").where("task = 'joint'")
    s = a.select("image_name", "dataset_path", "board", "package", "viewpoint", "light_direction", capture_timestamp("stem").alias("capture_timestamp"), F.posexplode("shapes").alias("pos", "shape"))
    raw = F.col("shape.label")
    known = F.coalesce(lookup(raw, taxonomy), F.raise_error(F.concat(F.lit("label without a class: "), F.coalesce(raw, F.lit("null")))))
    s = s.select("image_name", "dataset_path", "board", "package", "viewpoint", "light_direction", "capture_timestamp", "pos", raw.alias("raw_label"), known.alias("class"), F.col("shape.points").alias("points"))
    return positions(s.withColumn("_x", vertex_mean_x("points")), ["dataset_path"], "_x", "pos").drop("_x").withColumn("merged_from", F.lit(""))


def photos(records: DataFrame, path: str, order: str, first: list[str]) -> DataFrame:
    """One row a photo: the named columns of its first record, hint, number of records and the box around all polygons."""
    b = bbox("points")
    return records.groupBy(path).agg(
        *[F.min_by(c, order).alias(c) for c in first], F.count("*").alias("records"),
        F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"),
    ).withColumn("component_hint", component_hint(stem(path)))


def box_stats(records: DataFrame, by: list[str], points: str = "points") -> DataFrame:
    """(by..., n, mean and exact median of box width, height and polygon area)."""
    b = bbox(points)
    r = records.select(*by, (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"), polygon_area(points).alias("area"))
    sizes = ["w", "h", "area"]
    m = medians(r, by, sizes)  # every record has an area, so its number is that of the records
    return m.select(*by, F.col("n_area").alias("n"), *[f"{k}_{c}" for c in sizes for k in ("mean", "median")])


def manifest(records: DataFrame, splits: DataFrame, margin: float, width: int, height: int, strict: bool = False) -> DataFrame:
    """A row a crop: ids, file, source, labels, split, box of the polygon and of the square crop in the frame.

    records: dataset_path, polygon_rank_x, board, package, viewpoint, light_direction, raw_label, class, points,
    polygon_count, joint_position; splits: crop_id (path#rank), group_id, split. Records without a split are left
    out, and joins.orphans() lists them; a strict manifest refuses them, with an error when it is read.
    """
    b = bbox("points")
    r = records.withColumn("key", crop_key("dataset_path", "polygon_rank_x"))
    s = splits.select(F.col("crop_id").alias("key"), "group_id", "split")
    j = (guarded_inner(r, s, ["key"], "split of joint") if strict else r.join(s, "key")).withColumn("_b", b).withColumn("_c", square_crop(F.col("_b"), margin, F.lit(width), F.lit(height)))
    ident = file_safe_id("board", "package", "viewpoint", "dataset_path", "polygon_rank_x")
    return j.select(
        ident.alias("crop_id"), F.concat(ident, F.lit(".png")).alias("image_file"), F.col("dataset_path").alias("source_path"), "board", "package", F.col("viewpoint").alias("view_folder"),
        "light_direction", "group_id", "split", F.col("raw_label").alias("label_raw"), F.col("class").alias("label"), F.col("polygon_count").alias("n_polygons_in_image"), "joint_position",
        (F.col("_b.x1") - F.col("_b.x0")).alias("bbox_w"), (F.col("_b.y1") - F.col("_b.y0")).alias("bbox_h"), polygon_area("points").alias("polygon_area"),
        *[F.col(f"_c.{c}").alias(f"crop_{c}") for c in ("x0", "y0", "x1", "y1")], (F.col("_c.x1") - F.col("_c.x0")).alias("crop_w"), (F.col("_c.y1") - F.col("_c.y0")).alias("crop_h"),
    )
