"""Samples that match target shares of categories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.labels import joint_class
from jointmill.functions.paths import board_of, crop_key
from jointmill.llm.feistel import digest_number
from jointmill.operators.joins import skew_safe_lookup
from jointmill.session import written

TARGET_COLUMNS = ("target_id", "plan_id", "board", "sample_size", "class_name", "package", "target_pct", "min_count")
#: Hex digits of a crop's random key, and about how many crops of a category are ranked in one window.
DIGITS, RANKED = 13, 5_000


def categories(crops: DataFrame) -> DataFrame:
    """(key, board, class_name, packages) of different crops that have a class, all in plain form; one shuffle."""
    c = crops.select(crop_key("dataset_path", "polygon_rank_x").alias("key"), board_of("board", "dataset_path").alias("board"), "package", joint_class("class_name").alias("class_name"))
    c = c.where("class_name is not null and key is not null and board is not null")
    return c.groupBy("key", "board", "class_name").agg(F.array_sort(F.collect_set("package")).alias("packages"))


def available(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with their class in plain form and `have`, the different crops of board, class and (if given) package."""
    n = counted.select("board", "class_name", F.explode("packages").alias("package")).groupBy("board", "class_name", "package").agg(F.count("*").alias("have"))
    whole = counted.groupBy("board", "class_name").agg(F.count("*").alias("all"))
    t = targets.withColumn("class_name", joint_class("class_name"))
    t = t.join(n, ["board", "class_name", "package"], "left").join(whole, ["board", "class_name"], "left")
    return t.withColumn("have", F.coalesce(F.when(F.col("package").isNull(), F.col("all")).otherwise(F.col("have")), F.lit(0).cast("long"))).drop("all")


def allocate(size: int, pct: list[float], least: list[int], have: list[int]) -> list[int]:
    """Whole quotas for one plan.

    A category gets its share of a common level, but not less than its floor, as far as crops are there, and not more
    than is there; the level is the one at which the quotas add up to the sample size. What stands at neither its
    floor nor its cap is rounded by largest remainder (the earlier one of equals), in whole numbers, so nothing depends on
    floating point. Floors win over the sample size if they add up to more; caps leave the sample short if all are reached.
    """
    low = [min(max(m, 0), h) for m, h in zip(least, have, strict=True)]
    if sum(low) >= size or not any(pct):
        return low
    ends = sorted({(b, p) for lo, hi, p in zip(low, have, pct, strict=True) if p > 0 for b in (lo, hi)}, key=lambda e: e[0] / e[1])
    at = lambda num, den: sum(min(max(lo * den, num * p), hi * den) if p > 0 else lo * den for lo, hi, p in zip(low, have, pct, strict=True))
    num, den = next(((n, d) for n, d in ends if at(n, d) >= size * d), ends[-1])
    if at(num, den) < size * den:
        return [hi if p > 0 else lo for lo, hi, p in zip(low, have, pct, strict=True)]
    # just below that level, these are still growing
    grow = [p > 0 and lo * p >= 0 and lo * den < num * p <= hi * den for lo, hi, p in zip(low, have, pct, strict=True)]
    out = [lo if not p or num * p <= lo * den else hi for lo, hi, p in zip(low, have, pct, strict=True)]
    rest, share = size - sum(q for q, g in zip(out, grow, strict=True) if not g), sum(p for p, g in zip(pct, grow, strict=True) if g)
    for i in (i for i, g in enumerate(grow) if g):
        out[i] = rest * pct[i] // share
    order = sorted((i for i, g in enumerate(grow) if g), key=lambda i: (-(rest * pct[i] % share), i))
    for i in order[: size - sum(out)]:
        out[i] += 1
    return out


def quotas(targets: DataFrame) -> DataFrame:
    """targets with `quota`; the rows of one plan, which someone wrote by hand, meet in one call."""
    keep = targets.withColumn("quota", F.lit(0).cast("long"))

    def of_plan(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("target_id", na_position="last").reset_index(drop=True)
        number = lambda c: t[c].fillna(0).astype("int64").tolist()
        t["quota"] = allocate(max(number("sample_size"), default=0), number("target_pct"), number("min_count"), number("have"))
        return t

    return targets.groupBy("plan_id").applyInPandas(of_plan, keep.schema)


def allocated(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Every target with have, quota, short_by_count and short_by_share: the categories are counted and the plans allocated."""
    t = quotas(available(counted, targets.select(*TARGET_COLUMNS)))
    share = F.coalesce(F.col("target_pct").cast("long") * F.col("sample_size"), F.lit(0).cast("long"))
    return t.withColumns({"short_by_count": F.coalesce(F.col("have") < F.col("min_count"), F.lit(False)), "short_by_share": F.col("have") * 100 < share})


def shortfalls(crops: DataFrame, targets: DataFrame) -> DataFrame:
    """allocated() of the crops' categories; which targets fall short is known before anything is drawn."""
    return allocated(categories(crops), targets)


def target_sample(crops: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample: plan_id, target_id, crop_id; report: every target with have, quota, drawn, short_by_count, short_by_share).

    Counts categories, allocates quotas by largest remainder with floors and caps, and draws in every category the
    crops with the smallest random keys. A key depends on seed and crop alone, so plans over one category draw nested
    samples and a larger quota keeps the smaller one's crops. A target without a package draws from the packages that no
    other target of its plan and class names.

    Keys are spread evenly, so a category is cut into ranges of keys holding about RANKED crops each; ranges are
    counted, those beyond the last one any plan reaches leave, and a crop's place is the count of the ranges before its own
    and its place within it. No task ranks a whole category, however many of the crops it holds.

    Defined results: a crop without a class counts nowhere; one filed under two classes counts in both; a target whose
    class is none of the four, or whose board is null, has no crops; null percentages and counts are 0, plans of a null
    plan_id form one plan; columns of targets beyond those named in TARGET_COLUMNS are left out. short_by_count: fewer crops
    than min_count; short_by_share: fewer than target_pct of sample_size.
    """
    counted = written(categories(crops), "categories")
    t = allocated(counted, targets)
    named = Window.partitionBy("plan_id", "board", "class_name")
    t = t.withColumn("taken", F.when(F.col("package").isNull(), F.array_sort(F.collect_set("package").over(named))).otherwise(F.array().cast("array<string>")))
    signature = F.to_json(F.struct("board", "class_name", "package", "taken"), {"ignoreNullFields": "false"})
    t = written(t.withColumn("category", F.when(F.col("class_name").isNotNull() & F.col("board").isNotNull(), signature)), "quotas")
    wanted = t.where("quota > 0").groupBy("category", "board", "class_name", F.col("package").alias("p"), "taken").agg(F.max("quota").alias("most"), F.max("have").alias("have"))
    of_class = F.struct("board", "class_name").alias("class")
    # the categories of a board and class, one row of few
    lists = wanted.groupBy(of_class).agg(F.collect_list(F.struct("category", "p", "taken", "most", "have")).alias("wanted"))
    sizes = counted.groupBy(of_class).agg(F.count("*").alias("n"))
    total = counted.count()
    c = skew_safe_lookup(counted.select(of_class, "key", "packages", digest_number(F.concat(F.lit(f"{seed}:"), "key"), DIGITS).alias("r")), lists.join(sizes, "class"), "class", "n", total)
    free = F.exists("packages", lambda p: ~F.array_contains("w.taken", p)) | (F.size("packages") == 0)
    there = F.when(F.col("w.p").isNull(), free).otherwise(F.array_contains("packages", F.col("w.p")))
    pool = c.select("key", "r", "packages", F.explode("wanted").alias("w")).where(there)
    ranges = F.greatest(F.lit(1), F.ceil(F.col("w.have") / RANKED))
    pool = pool.select("key", "r", "w.category", "w.most", F.floor(F.col("r") * (ranges / float(16**DIGITS))).alias("range"))
    counts = pool.groupBy("category", "range").agg(F.count("*").alias("n"), F.max("most").alias("most"))
    before = Window.partitionBy("category").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).where("base < most").select(F.col("category").alias("_c"), F.col("range").alias("_r"), "base")
    near = pool.join(reached, (F.col("category") == F.col("_c")) & (F.col("range") == F.col("_r")))
    within = Window.partitionBy("category", "range").orderBy("r", "key")
    ranked = near.withColumn("place", F.col("base") + F.row_number().over(within)).where("place <= most")
    drawn = ranked.select("category", "key", "place").join(t.where("quota > 0").select("plan_id", "target_id", "category", "quota"), "category").where("place <= quota")
    sample = drawn.select("plan_id", "target_id", F.col("key").alias("crop_id"))
    n = sample.groupBy("target_id").agg(F.count("*").alias("drawn"))
    report = t.join(n, "target_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    return sample, report.drop("taken", "category")
