"""Order within an image: ranks, the largest gap, merged joints, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.labels import PRECEDENCE, position_name, precedence
from jointmill.functions.geometry import rectangle
from jointmill.session import written


def global_rank(rows: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """rows with their place, from 1, in one order over all of them; the order should end in a key.

    Rows are spread over ranges of the order with about equally many a range; ranges are counted first, rows within one
    placed next, so no task sorts all rows. Written, as ranges are found by sampling and must be the same for both steps.
    """
    r = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = r.groupBy("_range").agg(F.count("*").alias("_k")).select("_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(*order)
    return r.join(base, "_range").withColumn(name, F.col("_base") + F.row_number().over(within)).drop("_range", "_base")


def rank_within(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """1-based rank in the group; the order should end in a key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def largest_gap_clusters(rows: DataFrame, group: list[str], x: str, item: str, name: str = "cluster") -> DataFrame:
    """rows with a cluster of 1 or 2: the group, in the order of x and item, is cut at its first largest gap.

    A group of one row is one cluster; a group of two or more is always cut, even if all gaps are zero. The cut is the
    row whose gap to the next is largest (first on ties), found with two windows over the group.
    """
    w = Window.partitionBy(*group).orderBy(x, item)
    whole = Window.partitionBy(*group)
    g = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_gap", F.lead(x).over(w) - F.col(x))
    best = F.max(F.when(F.col("_gap").isNotNull(), F.struct(F.col("_gap").alias("g"), (-F.col("_rn")).alias("r")))).over(whole)
    cut = g.withColumn("_cut", -best["r"])
    return cut.withColumn(name, F.when(F.col("_cut").isNull() | (F.col("_rn") <= F.col("_cut")), 1).otherwise(2)).drop("_rn", "_gap", "_cut")


def reduced(rows: DataFrame, group: list[str], label: str, x: str, item: str, box: list[str]) -> DataFrame:
    """One row a cluster: (group..., item, kept label, merged_from, box, n).

    The label kept is the first in merge order; the item is its first row in the order of x and item. merged_from lists
    the kept label, then rows of a label already seen in the order of the labels' first rows, then the other
    labels in merge order, joined by `+`; a cluster of one row has an empty text. The box is the union.
    """
    order = Window.partitionBy(*group).orderBy(x, item)
    label_order = Window.partitionBy(*group, label).orderBy(x, item)
    r = rows.withColumn("_rn", F.row_number().over(order)).withColumn("_cr", F.row_number().over(label_order))
    r = r.withColumn("_first", F.min("_rn").over(Window.partitionBy(*group, label))).withColumn("_p", precedence(label))
    r = r.withColumn("_kept", F.min(F.struct(F.coalesce("_p", F.lit(len(PRECEDENCE))).alias("p"), F.col("_rn").alias("r"))).over(Window.partitionBy(*group)))
    is_kept = F.col("_rn") == F.col("_kept.r")
    phase = F.when(is_kept, 0).when(F.col("_cr") > 1, 1).otherwise(2)
    place = F.when(is_kept, 0).when(F.col("_cr") > 1, F.col("_first")).otherwise(F.coalesce("_p", F.lit(len(PRECEDENCE))))
    said = F.array_sort(F.collect_list(F.struct(phase.alias("a"), place.alias("b"), F.col("_rn").alias("c"), F.col(label).alias("l"))))
    out = r.groupBy(*group).agg(
        F.max(F.when(is_kept, F.col(item))).alias(item), F.max(F.when(is_kept, F.col(label))).alias(label), F.count("*").alias("n"), said.alias("_said"),
        F.min(box[0]).alias("x0"), F.min(box[1]).alias("y0"), F.max(box[2]).alias("x1"), F.max(box[3]).alias("y1"),
    )
    joined = F.array_join(F.transform("_said", lambda s: s["l"]), "+")
    return out.withColumn("merged_from", F.when(F.col("n") > 1, joined).otherwise("")).drop("_said")


def positions(rows: DataFrame, group: list[str], x: Column | str, item: str) -> DataFrame:
    """rows with polygon_count, polygon_rank_x and joint_position counted anew."""
    w, whole = Window.partitionBy(*group).orderBy(x, item), Window.partitionBy(*group)
    r = rows.withColumn("polygon_rank_x", F.row_number().over(w)).withColumn("polygon_count", F.count("*").over(whole).cast("int"))
    return r.withColumn("joint_position", position_name(F.col("polygon_rank_x"), F.col("polygon_count")))


def merged_joints(rows: DataFrame, image: list[str], label: str, item: str, box: list[str]) -> DataFrame:
    """Joints of each image: clusters at the largest gap of box centres, each reduced to one row, positions anew."""
    x = (F.col(box[0]) + F.col(box[2])) / 2
    c = largest_gap_clusters(rows.withColumn("_x", x), image, "_x", item)
    one = reduced(c, [*image, "cluster"], label, "_x", item, box)
    out = positions(one, image, (F.col("x0") + F.col("x1")) / 2, item)
    return out.withColumn("points", rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
