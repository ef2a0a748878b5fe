"""Queries of the training-data problems over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jointmill.functions.labels import split_name
from jointmill.functions.paths import board_of, crop_key, plain_crop_id
from jointmill.llm import entity_splits, feistel, fusion, mixture, overlap, pieces, quotas, tokens
from jointmill.llm.topn import top_n_per_group
from jointmill.session import table, written


def latest_predictions(rows: DataFrame) -> DataFrame:
    """Usable prediction rows, the latest of each run and crop; copies collapse."""
    ok = rows.select("run_id", "label", "pred", "crop_id", "score", "scored_at")
    ok = ok.where("score is not null and not isnan(score) and pred between 0 and 3 and crop_id is not null")
    last = ok.groupBy("run_id", "crop_id").agg(F.max(F.struct("scored_at", "label", "pred", "score")).alias("last"))
    return last.select("run_id", F.col("last.label").alias("label"), F.col("last.pred").alias("pred"), "crop_id", F.col("last.score").alias("score"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_predictions(table(spark, sf_dir, "predictions"))
    best = top_n_per_group(rows, ["run_id", "label", "pred"], "score", "crop_id", 3, F.col("pred") != 0, unique=True)
    return best.select("run_id", "label", "pred", "crop_id")


#: Share of a choice's crops that p2_sample and p2_growth draw.
SAMPLE_RATE = 0.2


def _crops_of_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, crop_id, since) of the crops on the boards of every seed, with the time a crop was first there."""
    crops = table(spark, sf_dir, "crops")
    ids = crops.groupBy(crop_key("dataset_path", "polygon_rank_x").alias("crop_id")).agg(F.min(board_of("board", "dataset_path")).alias("board"), F.min("ingested_at").alias("since"))
    seeds = table(spark, sf_dir, "choices").select("seed", F.explode("boards").alias("board")).distinct()
    return ids.where("crop_id is not null").join(seeds, "board").select("seed", "crop_id", "since")


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, crop_id): of every seed the sample of the crops on its boards."""
    return feistel.stable_sample(_crops_of_seeds(spark, sf_dir).select("seed", "crop_id"), "crop_id", SAMPLE_RATE, "seed")


def p2_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, choice_index, crops, drawn, lost): samples drawn anew from the crop list of each version of every seed.

    The list of a version holds the crops ingested until it was frozen, so it grows. `lost` counts crops of the version before
    that its sample no longer holds, by the audit that p2_found uses.
    """
    versions = table(spark, sf_dir, "choices").groupBy("seed", "choice_index").agg(F.min("frozen_at").alias("frozen_at"))
    lists = _crops_of_seeds(spark, sf_dir).join(versions, "seed").where("since <= frozen_at").select("seed", "choice_index", "crop_id", "frozen_at")
    drawn = feistel.stable_sample(lists, "crop_id", SAMPLE_RATE, "seed")
    lost = feistel.broken_promises(drawn.withColumn("split", F.lit("val")), versions, ("val",))
    count = lambda d, n: d.groupBy("seed", "choice_index").agg(F.count("*").alias(n))
    out = count(lists, "crops").join(count(drawn, "drawn"), ["seed", "choice_index"], "left").join(count(lost, "lost"), ["seed", "choice_index"], "left")
    return out.na.fill(0, ["drawn", "lost"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "assignments").select("seed", "choice_index", plain_crop_id("crop_id").alias("crop_id"), split_name("split").alias("split"), "frozen_at")
    lost = feistel.broken_promises(entries, table(spark, sf_dir, "choices"))
    still = table(spark, sf_dir, "crops").select(crop_key("dataset_path", "polygon_rank_x").alias("crop_id")).distinct()
    return lost.join(still, "crop_id", "left_semi").select("seed", "choice_index", "crop_id")


#: Wanted shares of the splits.
SHARES = {"train": 0.6, "val": 0.2, "test": 0.2}


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_splits.photo_components(table(spark, sf_dir, "photo_groups"), table(spark, sf_dir, "tag_pairs"))[0]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_splits.linked_groups(_components(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, component): what p3_found says in pairs, one row a group."""
    return entity_splits.component_groups(_components(spark, sf_dir))


def p3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(crop_id, group_id, class_name, component, split) of every different crop."""
    crops = entity_splits.crop_records(table(spark, sf_dir, "crops"), _components(spark, sf_dir))
    return entity_splits.entity_splits(crops, "component", "class_name", SHARES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.exact_pairs(overlap.cross_split_pairs(table(spark, sf_dir, "photo_groups"), table(spark, sf_dir, "crops")))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(overlap.cross_split_pairs(table(spark, sf_dir, "photo_groups"), table(spark, sf_dir, "crops")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, class, polygon_rank_x) of the surviving records of joints with two or more records.

    The survivors are written first: read lazily, Spark would leave out every field and judgement that is not asked for here.
    """
    whole = written(fusion.survivors(table(spark, sf_dir, "polygons")), "survivors")
    return whole.where("several").select("set_id", "class", "polygon_rank_x")


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.survivors(table(spark, sf_dir, "polygons"))


def p5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, joints, sensitivity, specificity) of every annotator and way of entry."""
    return fusion.learned(table(spark, sf_dir, "polygons"))[0].select("source", "joints", "sensitivity", "specificity")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quotas.shortfalls(table(spark, sf_dir, "crops"), table(spark, sf_dir, "targets"))
    return report.where("short_by_count or short_by_share").select("target_id")


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotas.target_sample(table(spark, sf_dir, "crops"), table(spark, sf_dir, "targets"))[0]


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotas.target_sample(table(spark, sf_dir, "crops"), table(spark, sf_dir, "targets"))[1]


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(table(spark, sf_dir, "mixture"), table(spark, sf_dir, "documents")).where("short").select("mix_id", "source")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(table(spark, sf_dir, "mixture"), table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixed(table(spark, sf_dir, "mixture"), table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.pieces(table(spark, sf_dir, "documents"), table(spark, sf_dir, "piece_limits"), with_text=False)
    return cut.where("piece = 1").select("doc_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(table(spark, sf_dir, "documents"), table(spark, sf_dir, "piece_limits"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        p1_found, p2_found, p2_sample, p2_growth, p3_found, p3_groups, p3_split, p4_found, p4_report, p5_found, p5_survivors, p5_quality, p6_found, p6_sample, p6_report,
        p7_ids, p8_found, p8_report, p8_mix, p9_found, p9_pieces,
    ]
    return {f.__name__: f for f in named}
