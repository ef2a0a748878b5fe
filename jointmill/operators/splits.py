"""Frozen train/val/test splits: candidates, gates, choice, counts, content hash."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.labels import CLASSES
from jointmill.functions.scores import digest_number
from jointmill.operators.guards import require_domain, require_rows
from jointmill.operators.metrics import medians

SPLITS = ("train", "val", "test")
#: Least crops of normal, and of each defect class, in val and in test.
FLOOR_NORMAL, FLOOR_DEFECT = 12, 8


def fold_counts(ratios: tuple[float, float, float], tolerance: float = 1e-6) -> tuple[int, int, int, int]:
    """(folds, and how many of them each split gets): the fewest folds, 2 to 20, of which every ratio takes a whole number."""
    if any(r <= 0 for r in ratios) or abs(sum(ratios) - 1) > tolerance:
        raise ValueError("ratios must be positive and add up to 1")
    for k in range(2, 21):
        parts = [round(r * k) for r in ratios]
        if all(p >= 1 and abs(r * k - p) <= tolerance * k for p, r in zip(parts, ratios, strict=True)) and sum(parts) == k:
            return (k, *parts)
    raise ValueError(f"no number of folds up to 20 gives these ratios; the nearest are {nearest_ratios(ratios)}")


def nearest_ratios(ratios: tuple[float, float, float]) -> tuple[float, ...]:
    """The ratios with at most 20 folds that differ least in sum, fewest folds first."""
    options = [(a / k, b / k, (k - a - b) / k) for k in range(3, 21) for a in range(1, k - 1) for b in range(1, k - a)]
    return min(options, key=lambda o: round(sum(abs(x - y) for x, y in zip(o, ratios, strict=True)), 12))


def fold_of(group: Column | str, seed: Column, folds: int) -> Column:
    """Fold of a group for a candidate's seed; both engines can compute it from MD5."""
    g = F.col(group) if isinstance(group, str) else group
    digits = F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), g.cast("string"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(folds)).cast("int")


def dealt(fold: Column, counts: tuple[int, int, int, int]) -> Column:
    """Folds are dealt to train, val and test in this order."""
    _, train, val, _ = counts
    return F.when(fold < train, "train").when(fold < train + val, "val").otherwise("test")


def candidates(crops: DataFrame, group: str, label: str, ratios: tuple[float, float, float], number: int, seed: int = 0) -> DataFrame:
    """(candidate, split, label, n, groups): dense counts of every candidate assignment.

    Crops are first counted by group and label; only these counts meet the candidates.
    """
    counts = fold_counts(ratios)
    sizes = crops.groupBy(group, label).agg(F.count("*").alias("n"))
    each = sizes.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    each = each.withColumn("split", dealt(fold_of(group, F.col("candidate") + seed, counts[0]), counts))
    found = each.groupBy("candidate", "split", label).agg(F.sum("n").alias("n"), F.count("*").alias("groups"))
    labels = crops.select(label).distinct()
    spark = crops.sparkSession
    frame = spark.range(number).select(F.col("id").cast("int").alias("candidate")).crossJoin(spark.createDataFrame([(s,) for s in SPLITS], "split string")).crossJoin(F.broadcast(labels))
    return frame.join(found, ["candidate", "split", label], "left").na.fill(0, ["n", "groups"])


def scored(counted: DataFrame, label: str, ratios: tuple[float, float, float]) -> DataFrame:
    """(candidate, fails_normal, fails_defect, class_deviation, size_deviation) of every candidate.

    class_deviation sums the differences between each split's class shares and the shares of all; an empty split adds the number of
    classes. size_deviation sums the differences between size shares and ratios.
    """
    by_split, by_label, whole = Window.partitionBy("candidate", "split"), Window.partitionBy("candidate", label), Window.partitionBy("candidate")
    c = counted.withColumns({"s": F.sum("n").over(by_split), "l": F.sum("n").over(by_label), "t": F.sum("n").over(whole)})
    share = F.when(F.col("s") > 0, F.abs(F.col("n") / F.nullif(F.col("s"), F.lit(0)) - F.col("l") / F.nullif(F.col("t"), F.lit(0)))).otherwise(1.0)
    held = F.col("split").isin("val", "test")
    floor = F.when(F.col(label) == "normal", FLOOR_NORMAL).otherwise(FLOOR_DEFECT)
    low = held & (F.col("n") < floor)
    per = c.groupBy("candidate").agg(
        F.max((low & (F.col(label) == "normal")).cast("int")).alias("fails_normal"), F.max((low & (F.col(label) != "normal")).cast("int")).alias("fails_defect"), F.sum(share).alias("class_deviation")
    )
    ratio = F.when(F.col("split") == "train", ratios[0]).when(F.col("split") == "val", ratios[1]).otherwise(ratios[2])
    size = c.select("candidate", "split", "s", "t").distinct().groupBy("candidate").agg(F.sum(F.abs(F.col("s") / F.nullif(F.col("t"), F.lit(0)) - ratio)).alias("size_deviation"))
    return per.join(size, "candidate")


@dataclass
class Choice:
    """What chose a split: candidate and its deviations, how many were judged, and why others weren't taken."""

    candidate: int
    class_deviation: float
    size_deviation: float
    considered: int
    accepted: int
    rejections: dict[str, int]


def choose(crops: DataFrame, group: str, label: str, ratios=(0.6, 0.2, 0.2), number: int = 200, seed: int = 0) -> tuple[DataFrame, Choice]:
    """(crops with their split, choice): the candidate that passes all gates and deviates least, of equal ones the first."""
    s = scored(candidates(crops, group, label, ratios, number, seed), label, ratios)
    rows = s.orderBy("candidate").collect()  # one row a candidate
    good = [r for r in rows if not r["fails_normal"] and not r["fails_defect"]]
    tally = {"G1": 0, "G2": sum(r["fails_normal"] for r in rows), "G3": sum(r["fails_defect"] for r in rows)}
    if not good:
        raise ValueError(f"none of {number} candidates passes the gates: {tally}")
    best = min(good, key=lambda r: (round(r["class_deviation"], 12), round(r["size_deviation"], 12), r["candidate"]))
    counts = fold_counts(tuple(ratios))
    out = crops.withColumn("split", dealt(fold_of(group, F.lit(best["candidate"] + seed), counts[0]), counts))
    return out, Choice(best["candidate"], best["class_deviation"], best["size_deviation"], len(rows), len(good), tally)


def defect_classes(crops: DataFrame, label: str) -> DataFrame:
    """Different classes but normal."""
    return crops.where(F.col(label) != "normal").select(label).distinct()


def group_counts(crops: DataFrame, split: str, group: str, splits=SPLITS) -> DataFrame:
    """(split, groups): different groups of every split, 0 where there is none."""
    frame = crops.sparkSession.createDataFrame([(s,) for s in splits], f"{split} string")
    return frame.join(crops.groupBy(split).agg(F.count_distinct(group).alias("groups")), split, "left").na.fill(0, ["groups"])


def gate(crops: DataFrame, split: str, group: str, label: str, labels=CLASSES) -> DataFrame:
    """(gate, split, class, found, needed) of every gate that an assignment fails; no rows if it passes.

    G1: groups that lie in several splits (found), of which none may; G2 and G3: normal and defect crops of val and test.
    """
    g1 = leaks(crops, group, split).agg(F.count("*").alias("found")).where("found > 0")
    g1 = g1.select(F.lit("G1").alias("gate"), F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("class"), "found", F.lit(0).alias("needed"))
    m = gate_margins(dense_counts(crops, split, label, labels=labels), split, label).where("slack < 0")
    low = m.select(F.when(F.col(label) == "normal", "G2").otherwise("G3").alias("gate"), F.col(split).alias("split"), F.col(label).alias("class"), F.col("n").alias("found"), F.col("floor").alias("needed"))
    return g1.unionByName(low)


def class_counts_of(manifest: DataFrame, split: str, label: str = "label", of: str = "split", labels=CLASSES) -> DataFrame:
    """(label, n) of one split over all classes, 0 where there is none; an unknown label, or a split without rows, raises."""
    own = require_rows(manifest.where(F.col(of) == split), f"split {split}")
    n = require_domain(own, label, list(labels)).groupBy(label).agg(F.count("*").alias("n"))
    frame = manifest.sparkSession.createDataFrame([(c,) for c in labels], f"{label} string")
    return frame.join(n, label, "left").na.fill(0, ["n"])


def crop_summary(manifest: DataFrame, merged_from: str = "merged_from") -> DataFrame:
    """One row on a run of crops: crops, merged, crops a split and a class, and the whole-number median crop size."""
    count = lambda c, v: F.sum((F.col(c) == v).cast("long"))
    sums = manifest.agg(
        F.count("*").alias("crops"), F.sum((F.coalesce(merged_from, F.lit("")) != "").cast("long")).alias("merged"),
        *[count("split", s).alias(s) for s in SPLITS], *[count("label", c).alias(c) for c in CLASSES],
    )
    mid = medians(manifest.select(F.lit(0).alias("_k"), "crop_w", "crop_h"), ["_k"], ["crop_w", "crop_h"])
    return sums.crossJoin(F.broadcast(mid.select(*[F.col(f"median_{c}").cast("int").alias(f"median_{c}") for c in ("crop_w", "crop_h")])))


def leaks(crops: DataFrame, group: str, split: str = "split") -> DataFrame:
    """(group, splits): groups that lie in more than one split."""
    return crops.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def dense_counts(rows: DataFrame, split: str, label: str, splits=SPLITS, labels=CLASSES) -> DataFrame:
    """(split, label, n) over all splits and labels, 0 where there is none."""
    spark = rows.sparkSession
    frame = spark.createDataFrame([(s, c) for s in splits for c in labels], f"{split} string, {label} string")
    return frame.join(rows.groupBy(split, label).agg(F.count("*").alias("n")), [split, label], "left").na.fill(0, ["n"])


def count_table(rows: DataFrame, split: str, label: str, group: str, labels=CLASSES, total: str = "total") -> DataFrame:
    """A row a split and a total row: groups, crops and a column a class. The total of groups is the sum over splits."""
    p = rows.groupBy(split).pivot(label, list(labels)).agg(F.count(F.lit(1))).na.fill(0, list(labels))
    g = rows.groupBy(split).agg(F.count_distinct(group).alias("groups"), F.count("*").alias("crops"))
    t = g.join(p, split)
    columns = ["groups", "crops", *labels]
    return t.unionByName(t.agg(*[F.sum(c).alias(c) for c in columns]).withColumn(split, F.lit(total)))


def gate_margins(dense: DataFrame, split: str, label: str) -> DataFrame:
    """(split, label, n, floor, slack) of val and test."""
    floor = F.when(F.col(label) == "normal", FLOOR_NORMAL).otherwise(FLOOR_DEFECT)
    return dense.where(F.col(split).isin("val", "test")).withColumn("floor", floor).withColumn("slack", F.col("n") - F.col("floor"))


def split_hash(rows: DataFrame, item: str, split: str, by: list[str]) -> DataFrame:
    """(by..., split_hash): SHA-256 of the sorted `item,split` lines. The digest is of one text, so a key's lines meet in one task."""
    r = rows.withColumn("_line", F.concat(F.col(item), F.lit(","), F.col(split)))
    return r.groupBy(*by).agg(F.sha2(F.expr("listagg(_line, '\\n') within group (order by _line)"), 256).alias("split_hash"))


def split_fingerprint(rows: DataFrame, item: str, split: str, by: list[str], parts: int = 4096) -> DataFrame:
    """(by..., fingerprint, n): SHA-256 over the digests of hash parts, for assignments too large for one text.

    Equal assignments have equal fingerprints whatever their order and partitioning; copies count.
    """
    r = rows.withColumn("_line", F.concat(F.col(item), F.lit(","), F.col(split))).withColumn("_p", F.pmod(digest_number(F.col(item), 8), F.lit(parts)))
    small = r.groupBy(*by, "_p").agg(F.sha2(F.expr("listagg(_line, '\\n') within group (order by _line)"), 256).alias("h"), F.count("*").alias("k"))
    return small.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("fingerprint"), F.sum("k").alias("n"))
