"""Joins: resolution, guarded inner joins, positional joins, and lookups that withstand hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.labels import class_number
from jointmill.session import written

#: Rows of one key that a task takes without ado, and how many hotter keys are looked up by a broadcast at most.
TASK_ROWS, HOT_KEYS = 1_000_000, 100_000


def skew_safe_lookup(rows: DataFrame, per_key: DataFrame, key: str, degree: str, total: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """Inner join of rows with one row per key, where `degree` of per_key counts the rows of its key.

    Keys with more than `task_rows` rows are looked up by a broadcast, the others are joined by shuffling on the key.
    `total` rows hold at most total / task_rows such keys; should these be over HOT_KEYS, the bound rises to
    total / HOT_KEYS rows, so the broadcast never holds more than HOT_KEYS rows.
    """
    hot_from = max(task_rows, -(-total // HOT_KEYS))
    if total < hot_from:
        return rows.join(per_key.drop(degree), key)
    hot = per_key.where(F.col(degree) >= hot_from).drop(degree)
    cold = per_key.where(F.col(degree) < hot_from).drop(degree)
    in_hot = rows.join(F.broadcast(hot), key)
    in_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return in_hot.unionByName(in_cold)


#: Pairs of one key that a task makes without ado.
TASK_PAIRS = 4_000_000


def many_to_many(left: DataFrame, right: DataFrame, on: list[str], task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Inner join on `on` whose keys may have many rows on both sides.

    A key with over `task_pairs` pairs is cut: its left rows are dealt to as many parts as that takes, its right rows go to
    every part, so the pairs of a hot key are made by many tasks. Nulls in `on` match nothing.
    """
    keys = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r"))).na.drop(subset=on)
    pairs = F.col("_l").cast("double") * F.col("_r")
    hot = keys.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).where(pairs > task_pairs)
    if hot.isEmpty():
        return left.join(right, on)
    hot = written(hot.withColumn("_parts", F.least("_l", F.ceil(pairs / task_pairs)).cast("int")).drop("_l", "_r"), "hot")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), parts).cast("int")).drop("_parts")
    copied = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*on, "_part"]).drop("_part")


def resolve_prefer_elsewhere(records: DataFrame, files: DataFrame, key: str, own: str, path: str = "path", place: str = "folder") -> DataFrame:
    """Left join on key with one file a record: files outside the record's own folder first, then smallest path.

    `ambiguous` says whether more than one file was in the class that won. Paths are compared by segment.
    Records without a file keep a null path and are not ambiguous. A key's files are
    reduced to the two best places and the record's own before the join, so no name multiplies rows.
    """
    per_place = files.groupBy(key, place).agg(F.count("*").alias("n"), F.min(F.struct(F.split(path, "/").alias("s"), F.col(path).alias("p"))).alias("best"))
    first = per_place.groupBy(key).agg(F.min(F.struct("best", F.col(place).alias("at"))).alias("b1"), F.sum("n").alias("total"))
    second = per_place.join(first.select(key, "b1"), key).where(F.col(place) != F.col("b1.at")).groupBy(key).agg(F.min("best").alias("b2"))
    inside = per_place.select(key, F.col(place).alias(own), F.col("n").alias("n_inside"), F.col("best").alias("inside"))
    r = records.join(first, key, "left").join(second, key, "left").join(inside, [key, own], "left")
    elsewhere = F.when(F.col("b1.at") != F.col(own), F.col("b1.best")).otherwise(F.col("b2"))
    n_outside = F.col("total") - F.coalesce("n_inside", F.lit(0))
    ambiguous = F.when(elsewhere.isNotNull(), n_outside).otherwise(F.col("n_inside")) > 1
    return r.select(*[records[c] for c in records.columns], F.coalesce(elsewhere["p"], F.col("inside.p")).alias("resolved_path"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


def orphans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right lacks; a null key is an orphan."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """Keys that only one side has, with the side's name in `side`."""
    a = orphans(left, right, keys).withColumn("side", F.lit(names[0]))
    return a.unionByName(orphans(right, left, keys).withColumn("side", F.lit(names[1])))


def guarded_inner(left: DataFrame, right: DataFrame, keys: list[str], what: str = "key") -> DataFrame:
    """Inner join that must find every left row: a row without a partner raises when it is read."""
    flagged = left.join(right.withColumn("_there", F.lit(True)), keys, "left")
    named = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return flagged.where(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(f"no {what}: "), named)).cast("boolean")).otherwise(True)).drop("_there")


def left_with_default(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join whose absent values become the given defaults."""
    out = left.join(right, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def off_manifest(predictions: DataFrame, crops: DataFrame, label: str = "label", named: str = "class") -> DataFrame:
    """Predictions with the class of their crop and a reason, of crops that are missing or whose class isn't the label.

    A crop or label that is null agrees with nothing, as does a class that has no number.
    """
    c = crops.select("crop_id", F.col(named).alias("_class"), F.lit(True).alias("_there"))
    agrees = F.coalesce(class_number("_class") == F.col(label), F.lit(False))
    reason = F.when(F.col("_there").isNull(), "no crop").when(~agrees, "other label")
    return predictions.join(c, "crop_id", "left").withColumn("reason", reason).where("reason is not null").drop("_there").withColumnRenamed("_class", named)


def with_crops(predictions: DataFrame, crops: DataFrame, history: DataFrame | None = None, label: str = "label", named: str = "class") -> DataFrame:
    """Predictions with all columns of their crop and merged_from ('' where history has none).

    Predictions of another crop set raise when they are read: a crop that is missing, or whose class isn't the label.
    """
    p = guarded_inner(predictions, crops, ["crop_id"], "crop")
    agrees = F.coalesce(class_number(named) == F.col(label), F.lit(False))
    said = F.concat(F.lit("label disagrees with crop: "), F.col("crop_id"), F.lit(" "), F.coalesce(F.col(label).cast("string"), F.lit("null")), F.lit(" "), F.coalesce(named, F.lit("null")))
    p = p.where(F.when(agrees, True).otherwise(F.raise_error(said).cast("boolean")))
    if history is None:
        return p.withColumn("merged_from", F.lit(""))
    return left_with_default(p, history.select("crop_id", "merged_from"), ["crop_id"], {"merged_from": ""})


def positional_pairs(left: DataFrame, right: DataFrame, block: list[str], order: list[str | Column], item: str, names: tuple[str, str] = ("left_item", "right_item")) -> DataFrame:
    """Pairs of items at the same place in the two sides of a block; the longer side's rest has no pair."""
    w = Window.partitionBy(*block).orderBy(*order)
    number = lambda d, n: d.withColumn("place", F.row_number().over(w)).select(*block, "place", F.col(item).alias(n))
    return number(left, names[0]).join(number(right, names[1]), [*block, "place"])


def reference_pairs(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Smallest and largest item of every key that holds exactly two rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(item).alias("first_item"), F.max(item).alias("second_item")).where("n = 2").drop("n")


def option_grid(tables: list[DataFrame]) -> DataFrame:
    """All combinations of a few small option tables, whose product is the wanted result."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables)


def blocked_pairs(rows: DataFrame, block: list[str], item: str, keep: Column, columns: list[str]) -> DataFrame:
    """Pairs item_a < item_b within a block for which `keep`, over columns a_<c> and b_<c>, is true.

    The comparison inside a block is the operator's meaning; blocks are small cells of related photos. A column that
    two similar rows surely share may be given as part of the block to keep blocks small.
    """
    side = lambda p: rows.select(*block, F.col(item).alias(f"item_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return side("a").join(side("b"), block).where(F.col("item_a") < F.col("item_b")).where(keep).select(*block, "item_a", "item_b")
