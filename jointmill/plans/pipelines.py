"""The reference's commands as pipelines between tables: audit, ingest, group, split, make-crops, eval."""

from __future__ import annotations

import argparse
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jointmill.functions.geometry import bbox
from jointmill.functions.paths import component_hint, crop_key, stem
from jointmill.functions.scores import argmax, defect_score
from jointmill.operators import grouping, inventory, joins, metrics, polygons, similarity, splits, windows
from jointmill.operators.components import connected_components
from jointmill.operators.guards import require_unique
from jointmill.plans import options as settings
from jointmill.session import scope
from jointmill.sources import annotations as ann
from jointmill.sources import images, tables


def audit(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the inventory: files by extension and folder, duplicate names, tokens, cells, labels, unreadable files,
    where annotated photos are, which annotations are ambiguous or lack a photo, joint coverage, brightness of V1 photos by board and
    setup, and a sample of duplicate contents."""
    files = inventory.described(tables.list_files(spark, root))
    photos = files.where("is_image")
    texts = ann.read_texts(spark, root)
    a = ann.annotations(texts)
    base = root.rstrip("/").removeprefix("file://")
    below = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), f"^{base}/", "")
    own = a.select(F.col("image_name").alias("name"), F.regexp_extract(below("source"), r"^(.*)/[^/]*$", 1).alias("own"))
    found = joins.resolve_prefer_elsewhere(own, photos.select("name", "folder", "path"), "name", "own")
    at = inventory.described(found.where("resolved_path is not null").select("resolved_path"), "resolved_path")
    pixels = images.pixel_facts(spark, root).withColumn("path", below("path"))
    one = inventory.deepest(photos, "name", "path").select("path").join(photos.select("path", "board", "viewpoint", "setup"), "path").join(pixels, "path")
    contents = photos.select("name", "folder", "path").join(tables.content_hashes(spark, root).withColumn("path", below("path")), "path")
    return {
        "locations": inventory.value_counts(at, ["folder"]), "ambiguous": found.where("ambiguous").select("name").distinct(), "missing": found.where("resolved_path is null").select("name").distinct(),
        "coverage": inventory.coverage(at.where("task = 'joint' and board is not null and package is not null"), ["board", "package"], "viewpoint", ["V2", "V2.1"]),
        "brightness": inventory.brightness(one), "duplicates": inventory.duplicate_sample(contents, "name", "folder", "md5"),
        "extensions": inventory.value_counts(files, ["ext"]), "folders": inventory.value_counts(photos, ["folder"]), "layouts": inventory.value_counts(a.select("source", "layout").distinct(), ["layout"]),
        "mirrored": inventory.mirrored_folders(photos, "name", "folder"), "tokens": inventory.position_table(photos, inventory.name_tokens("stem"), "path"),
        "segments": inventory.position_table(photos, F.split("folder", "/"), "path"), "outliers": inventory.token_outliers(photos, inventory.name_tokens("stem"), "path"),
        "cells": inventory.ragged_cells(photos, ["board", "package"], "viewpoint"), "deepest": inventory.deepest(photos, "name", "path"),
        "labels": a.select(F.explode("labels").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")), "unreadable": ann.unreadable(texts),
    }


def ingest(spark: SparkSession, root: str) -> DataFrame:
    """Joint rows of all annotations of joint photos: flattened, merged at the largest gap, positions counted anew."""
    files = inventory.described(tables.list_files(spark, root)).where("is_image").select("name", "folder", "path")
    base = root.rstrip("/").removeprefix("file://")
    a = ann.annotations(ann.read_texts(spark, root)).where("layout <> 'coco'")
    rel = F.regexp_replace(F.regexp_replace("source", "^file:/+", "/"), f"^{base}/", "")
    a = a.withColumn("own", F.regexp_extract(rel, r"^(.*)/[^/]*$", 1))
    a = joins.resolve_prefer_elsewhere(a.withColumnRenamed("image_name", "name"), files, "name", "own").where("resolved_path is not null")
    flat = polygons.flattened(a.select(F.col("resolved_path").alias("dataset_path"), F.col("name").alias("image_name"), "shapes"))
    box = bbox("points")
    flat = flat.withColumns({f"b{k}": box[k] for k in ("x0", "y0", "x1", "y1")})
    merged = windows.merged_joints(flat, ["dataset_path"], "class", "pos", ["bx0", "by0", "bx1", "by1"])
    single = flat.select("dataset_path", "pos", F.col("points").alias("own_points"), "raw_label", "image_name", "board", "package", "viewpoint", "light_direction", "capture_timestamp")
    out = merged.join(single, ["dataset_path", "pos"]).withColumn("points", F.when(F.col("n") > 1, F.col("points")).otherwise(F.col("own_points")))
    names = [f.split()[0] for f in tables.POLYGONS.split(", ")]
    return out.select(*names)


def crop_run(joints: DataFrame, split_rows: DataFrame, margin: float = 0.1, width: int = 2560, height: int = 1440) -> tuple[DataFrame, DataFrame]:
    """(manifest, one row about it) of all joints; a joint without a split is refused when the manifest is read."""
    if margin < 0:
        raise ValueError("margin must be 0 or more")
    m = polygons.manifest(joints, split_rows, margin, width, height, strict=True)
    merged = joints.select(crop_key("dataset_path", "polygon_rank_x").alias("_k"), "merged_from")
    own = m.withColumn("_k", F.concat("source_path", F.lit("#"), F.regexp_extract("crop_id", r"(\d+)$", 1)))
    return m, splits.crop_summary(own.join(merged, "_k", "left"))


def group(joints: DataFrame, method: str, threshold: float | None = None, fingerprints: DataFrame | None = None) -> DataFrame:
    """Photos with group_id and size: coarse (by cell), phash (Hamming, needs dataset_path and fingerprint), embed (cosine, needs vector).

    Without a threshold pairs are within settings.THRESHOLDS.
    """
    p = joints.select("image_name", "dataset_path", "board", "package", "viewpoint").distinct().withColumn("cell", F.concat_ws("/", "board", "package"))
    if method == "coarse":
        rooted = p.withColumn("root", F.min("dataset_path").over(Window.partitionBy("cell")))
    else:
        if fingerprints is None:
            raise ValueError(f"{method} needs fingerprints")
        f = p.join(fingerprints, "dataset_path")
        limit = settings.threshold_of(method, threshold)
        pairs = similarity.hamming_pairs(f, ["cell"], "dataset_path", "fingerprint", int(limit)) if method == "phash" else similarity.cosine_pairs(f, ["cell"], "dataset_path", "vector", float(limit))
        rooted = grouping.with_components(p, "dataset_path", pairs)
    return grouping.group_ids(rooted, "root", "dataset_path", method)


def split(joints: DataFrame, groups: DataFrame, ratios=(0.6, 0.2, 0.2), candidates: int = 200, seed: int = 0, exact_hash: bool = False) -> tuple[DataFrame, dict]:
    """(crops with split and hash, provenance): every joint must have a group; ids must be unique.

    The hash is a fingerprint of hash parts; the exact one is of one text of all crops, which one task must make.
    """
    c = joints.withColumn("crop_id", crop_key("dataset_path", "polygon_rank_x"))
    c = joins.guarded_inner(c, groups.select("dataset_path", "group_id"), ["dataset_path"], "group for photo")
    require_unique(c, ["crop_id"], "crop id")
    out, choice = splits.choose(c, "group_id", "class", ratios, candidates, seed)
    of = splits.split_hash if exact_hash else splits.split_fingerprint
    h = of(out.withColumn("_k", F.lit(0)), "crop_id", "split", ["_k"]).first()
    digest = h[1] if h else None
    return out.withColumn("split_hash", F.lit(digest)), {"ratios": list(ratios), "seed": seed, "split_hash": digest, **asdict(choice)}


def evaluate(predictions: DataFrame, by: list[str] | None = None, max_miss: float = 0.10, crops: DataFrame | None = None, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """Confusion, recalls, mistakes, sweep, areas and operating point of predictions (crop_id, label, logits).

    Predictions of normal crops only, or of defects only, are refused. With crops (crop_id, class, ...), predictions of another crop set raise, and the rest have the columns of their crop, of
    which `by` may name some, and merged_from by history (crop_id, merged_from), if given.
    """
    if crops is not None:
        predictions = joins.with_crops(predictions, crops, history)
    metrics.require_both(predictions, "label")
    p = predictions.withColumns({"score": defect_score("logits").cast("float").cast("double"), "pred": argmax("logits"), "all": F.lit("all")})
    by = by or ["all"]
    c = metrics.confusion(p, "label", "pred", by)
    s = metrics.threshold_sweep(p, "score", F.col("label") != 0, by)
    return {
        "confusion": c, "recalls": metrics.recalls(c, by), "mistakes": metrics.mistakes(c, by), "sweep": s, "auroc": metrics.auroc(s, by), "auprc": metrics.auprc(s, by),
        "operating_point": metrics.operating_points(s, [max_miss], by), "gallery": metrics.gallery(p, "label", "pred", "score", "crop_id", 12, by),
    }


def main(argv: list[str] | None = None) -> None:
    """python -m jointmill.plans.pipelines audit|ingest|group|split|make-crops|eval|show|tag-export|qa-polygons|summarize|gallery|sweep ..."""
    a = argparse.ArgumentParser(prog="jointmill")
    sub = a.add_subparsers(dest="command", required=True)
    for name, options in {
        "audit": ["root", "out"], "ingest": ["root", "out"], "group": ["polygons", "out", "--method", "--threshold", "--fingerprints"], "split": ["polygons", "groups", "out", "--seed", "--candidates"],
        "make-crops": ["polygons", "splits", "out", "--margin", "--width", "--height"], "eval": ["predictions", "out", "--manifest"], "show": ["root", "out", "--board", "--package", "--viewpoint", "--setup"],
        "tag-export": ["polygons", "pairs", "out"], "qa-polygons": ["polygons", "out"], "summarize": ["predictions", "out", "--option"], "gallery": ["predictions", "out", "--per-cell"], "sweep": ["out", "--seeds", "--set"],
    }.items():
        p = sub.add_parser(name)
        for o in options:
            p.add_argument(o)
    x = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    with scope(spark):
        _command(spark, x)


def _command(spark: SparkSession, x: argparse.Namespace) -> None:
    """One command, whose intermediate tables go when its results are written."""
    if x.command == "audit":
        for k, df in audit(spark, x.root).items():
            tables.write_csv(df, f"{x.out}/{k}")
    elif x.command == "ingest":
        tables.write_csv(ingest(spark, x.root), x.out)
    elif x.command == "group":
        f = spark.read.parquet(x.fingerprints) if x.fingerprints else None
        tables.write_csv(group(tables.read_polygons(spark, x.polygons), x.method or "coarse", float(x.threshold) if x.threshold else None, f), x.out)
    elif x.command == "split":
        g = tables.read_groups(spark, x.groups)
        out, meta = split(tables.read_polygons(spark, x.polygons), g, seed=int(x.seed or 0), candidates=int(x.candidates or 200))
        tables.write_csv(out, x.out)
        tables.write_meta(meta, x.out.rstrip("/") + "_meta.json")
    elif x.command == "make-crops":
        s = tables.read_splits(spark, x.splits)
        m, said = crop_run(tables.read_polygons(spark, x.polygons), s, float(x.margin or 0.1), int(x.width or 2560), int(x.height or 1440))
        tables.write_csv(m, x.out)
        tables.write_csv(said, x.out.rstrip("/") + "_summary")
    elif x.command == "show":
        tables.write_csv(inventory.select_cell(inventory.described(tables.list_files(spark, x.root)).where("is_image"), x.board, x.package, x.viewpoint, x.setup).select("path"), x.out)
    elif x.command == "tag-export":
        photos = tables.read_polygons(spark, x.polygons).select("image_name", "dataset_path", "board", "package", "viewpoint").distinct().withColumn("component_hint", component_hint(stem("dataset_path")))
        tables.write_csv(grouping.manual_rows(photos, connected_components(grouping.set_edges(tables.read_pairs(spark, x.pairs), "members"))), x.out)
    elif x.command == "qa-polygons":
        tables.write_csv(polygons.box_stats(tables.read_polygons(spark, x.polygons), ["class", "package"]), x.out)
    elif x.command == "summarize":
        p = spark.read.parquet(x.predictions)
        option = x.option or "run_id"
        tables.write_csv(metrics.unusable(p, "label", "score", ["run_id"]), x.out.rstrip("/") + "_skipped")
        m = metrics.run_metrics(p, "label", "pred", "score").join(p.groupBy("run_id").agg(F.min(option).alias("option")), "run_id")
        tables.write_csv(metrics.mean_std(m, ["macro_recall", "normal_recall", "auroc", "far"], ["option"]), x.out)
    elif x.command == "gallery":
        tables.write_csv(metrics.dense_gallery(spark.read.parquet(x.predictions), "label", "pred", "score", "crop_id", int(x.per_cell or 12)), x.out)
    elif x.command == "sweep":
        tables.write_csv(settings.jobs(spark, settings.seeds_of(x.seeds or "0"), *(x.set or "").split()), x.out)
    else:
        c = spark.read.option("header", "true").csv(x.manifest).select("crop_id", "board", "package", F.col("label").alias("class")) if x.manifest else None
        for k, df in evaluate(spark.read.parquet(x.predictions), crops=c).items():
            tables.write_csv(df, f"{x.out}/{k}")


if __name__ == "__main__":
    main()
