"""Seeded samples and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.scores import digest_number


def seeded_order(seed: int, key: Column | str) -> Column:
    """Pseudorandom but fixed order of a key: MD5 of seed and key, as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def seeded_sample(rows: DataFrame, key: str, size: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """`size` rows, of every stratum if given, in the seeded order of the key; all of a smaller one.

    With strata each partition hands on only its first `size` rows a stratum; without, the sort keeps only `size`.
    """
    order = seeded_order(seed, key)
    if not strata:
        return rows.orderBy(order, key).limit(size)
    w = Window.partitionBy(*strata).orderBy("_o", key)
    return rows.withColumn("_o", order).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_o", "_r")


def largest_and_sample(groups: DataFrame, group: str, size: str, largest: int, sample: int, seed: int) -> DataFrame:
    """The `largest` groups (ties by id) and a seeded sample of the rest, with why each is there."""
    top = groups.orderBy(F.desc(size), group).limit(largest).withColumn("why", F.lit("largest"))
    rest = groups.join(top.select(group), group, "left_anti")
    return top.unionByName(seeded_sample(rest, group, sample, seed).withColumn("why", F.lit("sample")).select(top.columns))


def class_weights(counts: DataFrame, label: str, n: str, scheme: str = "inverse", beta: float = 0.999) -> DataFrame:
    """(label, n, weight): weights that add up to the number of classes.

    inverse: 1 / n. effective: (1 - beta) / (1 - beta**n); beta 0 gives ones, and beta outside 0 <= beta < 1 is refused.
    none: ones. Classes without rows raise when read.
    """
    if scheme not in ("inverse", "effective", "none"):
        raise ValueError(f"no such scheme: {scheme}")
    if not 0 <= beta < 1:
        raise ValueError("beta must lie in 0 <= beta < 1")
    c = F.when(F.col(n) > 0, F.col(n).cast("double")).otherwise(F.raise_error(F.lit("a class has no rows")).cast("double"))
    raw = F.lit(1.0) if scheme == "none" or (scheme == "effective" and beta == 0) else 1.0 / c if scheme == "inverse" else (1.0 - beta) / (1.0 - F.pow(F.lit(beta), c))
    whole = Window.partitionBy(F.lit(0))
    r = counts.select(label, n, raw.alias("_w"))
    return r.select(label, n, (F.col("_w") * F.count("*").over(whole) / F.sum("_w").over(whole)).alias("weight"))


#: Rows of a group that are numbered in one window.
TOGETHER = 50_000


def numbered(rows: DataFrame, group: str, key: str, seed: int, together: int = TOGETHER) -> DataFrame:
    """rows with `place`, from 0: their place in the group in a seeded pseudorandom order of the key.

    The order's numbers are spread evenly, so a group is cut into ranges of them that hold about `together` rows each;
    ranges are counted first, rows within one placed next, and no task numbers a whole group. Keys should be different.
    """
    r = rows.withColumn("_r", digest_number(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 13))
    sizes = rows.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / together)).alias("_ranges"))
    r = r.join(sizes, group).withColumn("_range", F.floor(F.col("_r") * (F.col("_ranges") / float(16**13))))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = r.groupBy(group, "_range").agg(F.count("*").alias("_n")).select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, "_range").orderBy("_r", key)
    return r.join(bases, [group, "_range"]).withColumn("place", F.col("_base") + F.row_number().over(within) - 1).drop("_r", "_ranges", "_range", "_base")


def weighted_sample(rows: DataFrame, key: str, label: str, weights: DataFrame, draws: int, seed: int, steps: int = 1_000_000) -> DataFrame:
    """`draws` draws with replacement, each row weighing what its label does: (draw, key, label).

    A label owns whole-number slots, its weight in `steps` times its rows. A draw is a slot number by the MD5 of seed and
    draw, which names the label, and a second one, which names the place among the label's rows; places are numbers of their
    own in a seeded order (numbered()), so draws find their rows by an equality join on label and place. Labels are
    classes, a handful, and reach the driver with a count each. A row whose label is null, or whose weight is null or not
    positive, is never drawn; without such rows there are no draws. Keys should be different.
    """
    counted = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).join(weights.select(label, "weight"), label)
    known = [(r[label], r["n"], round(r["weight"] * steps) * r["n"]) for r in counted.where("weight > 0").orderBy(label).collect()]
    known = [k for k in known if k[2] > 0]
    total, upto, at = sum(k[2] for k in known), 0, []
    for name, n, slots in known:
        upto += slots
        at.append((upto, name, n))
    spark = rows.sparkSession
    number = lambda what, of: F.pmod(digest_number(F.concat(F.lit(f"{seed}:{what}:"), F.col("draw").cast("string"))), of)
    d = spark.range(draws if total else 0).withColumnRenamed("id", "draw").withColumn("_slot", number("slot", F.lit(max(1, total))))
    which, size = F.lit(None).cast(dict(rows.dtypes)[label]), F.lit(None).cast("long")
    for upto, name, n in reversed(at):
        which, size = F.when(F.col("_slot") < upto, F.lit(name)).otherwise(which), F.when(F.col("_slot") < upto, F.lit(n)).otherwise(size)
    d = d.select("draw", which.alias(label), size.alias("_size")).withColumn("place", number("row", F.col("_size")))
    placed = numbered(rows.where(F.col(label).isNotNull()).select(key, label), label, key, seed)
    return d.join(placed, [label, "place"]).select("draw", key, label)
