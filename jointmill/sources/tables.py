"""Typed CSV and JSON tables, prediction bundles, file listings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jointmill.functions.labels import CLASSES, SPLITS
from jointmill.operators.guards import require_columns, require_domain, require_rows, require_unique

#: Said in every file of hand-made groups.
PAIRS_NOTE = "Groups made by hand: each lists the paths of photos that show one component."
POLYGONS = (
    "image_name string, dataset_path string, board string, package string, viewpoint string, light_direction string, capture_timestamp string, raw_label string,"
    " class string, points string, polygon_count int, polygon_rank_x int, joint_position string, merged_from string"
)
GROUPS = (
    "image_name string, dataset_path string, board string, package string, cell string, viewpoint string, component_hint string, method string, threshold string,"
    " crop_tolerance string, fingerprint string, group_id string, group_size int"
)
SPLIT = (
    "crop_id string, dataset_path string, polygon_rank_x string, joint_position string, board string, package string, cell string, viewpoint string, class string,"
    " group_id string, split string, split_hash string"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in the file system it belongs to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header whose names must hold those of the schema; columns are matched by name, empty text is null."""
    header = spark.read.option("header", "true").csv(path)
    wanted = [f.split()[0] for f in schema.split(", ")]
    require_columns(header, wanted, path)
    kinds = dict(f.strip().split() for f in schema.split(","))
    return header.select(*[F.col(c).cast(kinds[c]).alias(c) for c in wanted])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text, null as an empty field."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    df.withColumns(nested).write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of a CSV whose points are JSON text; text that isn't raises when read."""
    p = read_csv(spark, path, POLYGONS)
    return p.withColumn("points", F.from_json("points", "array<array<double>>", {"mode": "FAILFAST"})).na.fill("", ["merged_from", "capture_timestamp"])


def read_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(version, note, members) of a pairing file, one row a group; none if there is no file.

    The file system that the path belongs to is asked, so a path of a shared default file system is found there. `lines`
    is for what write_pairs() wrote, one JSON text a line. Groups come as they are stored; grouping.canonical_groups() unites overlapping ones.
    """
    schema = "version int, note string, groups array<array<string>>"
    if not exists(spark, path):
        return spark.createDataFrame([], "version int, note string, members array<string>")
    j = spark.read.schema(schema).option("multiLine", str(not lines)).json(path)
    return j.select("version", "note", F.explode("groups").alias("members"))


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """(crop_id, label, logits) and the mean loss of one bundle of arrays; objects in it are refused."""
    import numpy as np

    with np.load(path, allow_pickle=False) as z:
        ids, labels, logits, loss = z["crop_ids"].tolist(), z["labels"].tolist(), z["logits"].tolist(), float(z["mean_loss"])
    return spark.createDataFrame(list(zip(ids, labels, logits, strict=True)), "crop_id string, label bigint, logits array<float>"), loss


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_path, group_id) of a table of groups with all its columns; of rows of one path the last in group order holds."""
    g = read_csv(spark, path, GROUPS)
    return g.groupBy("dataset_path").agg(F.max("group_id").alias("group_id"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(crop_id, group_id, split) of a frozen split, whose columns must all be there and whose crops must be unique."""
    return require_unique(read_csv(spark, path, SPLIT), ["crop_id"], "crop").select("crop_id", "group_id", "split")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a manifest, as text; a missing file is an error that says so."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no manifest at {path}")
    return require_columns(spark.read.option("header", "true").csv(path), ["crop_id", "label", "split"], path)


def read_crop_set(spark: SparkSession, path: str, split: str, folder: str = "") -> DataFrame:
    """Manifest rows of one split with the file of each crop; a label that is no class raises when read, a split without rows at once.

    The filter reaches the scan. Rows keep no order: sort by crop_id, as the manifest is sorted.
    """
    if split not in SPLITS:
        raise ValueError(f"no such split: {split}")
    own = require_rows(read_manifest(spark, path).where(F.col("split") == split), f"split {split}")
    return require_domain(own, "label", list(CLASSES)).withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), "crop_id", F.lit(".png")))


def write_sweep(sweep: DataFrame, path: str) -> None:
    """threshold, miss and far of a sweep as CSV, to six decimals."""
    write_csv(sweep.select(*[F.format_string("%.6f", c).alias(c) for c in ("threshold", "miss", "far")]), path)


def write_pairs(memberships: DataFrame, path: str) -> None:
    """Hand-made groups (node, root) as JSON lines of version, note and one group each, sorted within; by the executors."""
    g = memberships.groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("m")).where(F.size("m") > 1)
    g.select(F.lit(1).alias("version"), F.lit(PAIRS_NOTE).alias("note"), F.array("m").alias("groups")).write.mode("overwrite").json(path)


def save_groups(groups: DataFrame, path: str, most: int = 100_000) -> list[list[str]]:
    """Hand-made groups (root, members) as one sorted, indented JSON file that a person can read; refuses more than `most`."""
    rows = groups.select("members").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups are no table to read; write_pairs() takes them")
    out = sorted(sorted(r["members"]) for r in rows)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    write_meta({"version": 1, "note": PAIRS_NOTE, "groups": out}, path)
    return out


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of all files below root, without reading them; paths are relative to root."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    return f.select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{base}/", "").alias("path"), "length", F.col("modificationTime").alias("modified"))


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, md5) of all files below root."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return f.select("path", F.md5("content").alias("md5"))


def write_meta(meta: dict, path: str) -> None:
    """Small provenance record as sorted, indented JSON."""
    Path(path).write_text(json.dumps(meta, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def read_meta(path: str, key: str):
    """A value of a provenance record, None if there is no such file or key or it isn't JSON."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8")).get(key)
    except (OSError, ValueError, AttributeError):
        return None


def replace_section(path: str, section: str, begin: str, end: str) -> bool:
    """Put section between two marker lines of a text file, or append it with them; says whether it was there before."""
    p = Path(path)
    text = p.read_text(encoding="utf-8")
    block = f"{begin}\n{section.rstrip()}\n{end}"
    i, j = text.find(begin), text.find(end)
    there = 0 <= i < j
    p.write_text(text[:i] + block + text[j + len(end) :] if there else text.rstrip("\n") + "\n\n" + block + "\n", encoding="utf-8")
    return there
