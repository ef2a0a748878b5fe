"""Scores against truth: sweeps, operating points, areas, confusion, galleries, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.labels import CLASSES
from jointmill.functions.scores import ratio

#: Scores of a key that are summed up in one window, and ranges that a key's scores are cut into at most.
TOGETHER, RANGES = 50_000, 512


def running_sums(counts: DataFrame, by: list[str], score: str, sums: list[str], together: int = TOGETHER) -> DataFrame:
    """counts (one row a key and score) with cum_<s> of each sum over the scores from the highest down to its own, and all_<s>.

    A key with more than `together` scores is cut at quantiles of its own scores, so its ranges hold about equally many
    however the scores crowd; totals of the ranges are summed first, then the scores within each, so no task sorts all
    scores of a key. Quantiles may be approximate: they only say where to cut. Null and NaN scores must have been removed.
    """
    places = [i / RANGES for i in range(1, RANGES)]
    ends = counts.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx(score, places, F.lit(4 * RANGES)).alias("_q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGES * together) / F.col("_n")).cast("int"))
    cuts = F.when(F.col("_n") > together, F.array_distinct(F.filter("_q", lambda _, i: (i + 1) % step == 0)))
    ends = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], cuts.alias("_cuts"))
    if by:
        on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
        c = counts.join(ends, on).drop(*[f"_k{i}" for i in range(len(by))])
    else:
        c = counts.crossJoin(F.broadcast(ends))
    below = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda x: x < F.col(score))))
    c = c.withColumn("_b", below).drop("_cuts")
    totals = c.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    above = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(by)], F.col("_b").alias("_kb"), *[F.coalesce(F.sum(f"_t_{s}").over(above), F.lit(0)).alias(f"_a_{s}") for s in sums], *[F.sum(f"_t_{s}").over(Window.partitionBy(*by)).alias(f"all_{s}") for s in sums])
    on = [F.col(x).eqNullSafe(F.col(f"_k{i}")) for i, x in enumerate(by)] + [F.col("_b") == F.col("_kb")]
    within = Window.partitionBy(*by, "_b").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = c.join(totals, on)
    out = out.withColumns({f"cum_{s}": F.col(f"_a_{s}") + F.sum(s).over(within) for s in sums})
    return out.drop("_b", "_kb", *[f"_k{i}" for i in range(len(by))], *[f"_a_{s}" for s in sums])


def medians(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by..., mean_<v>, median_<v>, n_<v> of each value): exact medians by counts and running_sums(), so no buffer holds a
    key's values, in one pass over the rows.

    Null and NaN values don't count; a key without any value is left out.
    """
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("m"), F.col(v).cast("double").alias("x")) for v in values])).alias("_v")).select(*by, "_v.m", "_v.x")
    counts = long.where("x is not null and not isnan(x)").groupBy(*by, "m", "x").agg(F.count("*").alias("n"))
    c = running_sums(counts, [*by, "m"], "x", ["n"])
    covers = lambda place: F.when((F.col("cum_n") - F.col("n") < place) & (place <= F.col("cum_n")), F.col("x"))
    low, high = F.floor((F.col("all_n") + 1) / 2), F.floor(F.col("all_n") / 2) + 1
    mid = c.groupBy(*by, "m").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), ((F.max(covers(low)) + F.max(covers(high))) / 2).alias("median"), F.sum("n").alias("n"))
    names = ("mean", "median", "n")
    wide = mid.groupBy(*by).pivot("m", values).agg(*[F.max(k).alias(k) for k in names])
    return wide.withColumnsRenamed({f"{v}_{k}": f"{k}_{v}" for v in values for k in names})


def _scored(rows: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    ok = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & positive.isNotNull())
    return ok.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(F.when(positive, 1).otherwise(0)).alias("pos"), F.sum(F.when(positive, 0).otherwise(1)).alias("neg"))


def threshold_sweep(rows: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., threshold, miss, far, flagged) for every distinct score; a row is flagged from the threshold on.

    miss is the share of positives below the threshold, far the share of negatives flagged, either 0.0 where there are
    none. Rows with null or NaN score or null truth don't count.
    """
    by = by or []
    cum = running_sums(_scored(rows, by, score, positive), by, "threshold", ["pos", "neg"])
    joined = cum.withColumnsRenamed({"all_pos": "P", "all_neg": "N"})
    return joined.select(
        *by, "threshold", ratio(F.col("P") - F.col("cum_pos"), F.col("P")).alias("miss"), ratio(F.col("cum_neg"), F.col("N")).alias("far"),
        (F.col("cum_pos") + F.col("cum_neg")).alias("flagged"), "pos", "neg", "cum_pos", "cum_neg", "P", "N",
    )


def operating_points(sweep: DataFrame, limits: list[float], by: list[str]) -> DataFrame:
    """(by..., max_miss, threshold, miss, far): the largest threshold whose miss keeps each limit; nulls if none does."""
    out = None
    for limit in limits:
        best = F.max_by(F.struct("threshold", "miss", "far"), F.when(F.col("miss") <= F.lit(float(limit)), F.col("threshold")))
        one = sweep.groupBy(*by).agg(best.alias("b")).select(*by, F.lit(float(limit)).alias("max_miss"), "b.threshold", "b.miss", "b.far")
        out = one if out is None else out.unionByName(one)
    return out


def auroc(sweep: DataFrame, by: list[str]) -> DataFrame:
    """(by..., auroc) by rank sums with average ranks for ties; null where one class is missing."""
    # a tied block of neg negatives lies below cum_pos - pos positives for sure and beside pos others
    wins = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos")) + F.col("neg") * F.col("pos") / F.lit(2.0))
    both = F.max("P") * F.max("N")
    return sweep.groupBy(*by).agg(F.when(both > 0, wins / F.nullif(both, F.lit(0))).alias("auroc"))


def auprc(sweep: DataFrame, by: list[str]) -> DataFrame:
    """(by..., auprc): average precision, the precision at each distinct score weighted by the recall it adds."""
    gain = F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return sweep.groupBy(*by).agg(F.when(F.max("P") > 0, F.sum(gain) / F.nullif(F.max("P"), F.lit(0))).alias("auprc"))


def grid(spark, by_values: DataFrame | None = None) -> DataFrame:
    """Dense true × predicted grid of the four classes, for every row of by_values if given."""
    n = len(CLASSES)
    g = spark.range(n * n).select((F.col("id") / n).cast("int").alias("truth"), (F.col("id") % n).cast("int").alias("pred"))
    return by_values.crossJoin(F.broadcast(g)) if by_values is not None else g


def confusion(rows: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by..., truth, pred, n, share): counts over the dense class grid, share of the truth's rows or 0.0."""
    by = by or []
    counts = rows.groupBy(*by, F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    dense = grid(rows.sparkSession, rows.select(*by).distinct() if by else None).join(counts, [*by, "truth", "pred"], "left").na.fill(0, ["n"])
    return dense.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*by, "truth"))))


def recalls(confused: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., truth, support, recall, predicted, precision, f1) of each class, 0.0 on empty denominators."""
    by = by or []
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    t = confused.groupBy(*by, "truth").agg(F.sum("n").alias("support"), hit.alias("hits"))
    p = confused.groupBy(*by, F.col("pred").alias("truth")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, [*by, "truth"])
    recall, precision = ratio(F.col("hits"), F.col("support")), ratio(F.col("hits"), F.col("predicted"))
    return j.select(*by, "truth", "support", recall.alias("recall"), "predicted", precision.alias("precision"), ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"))


def gallery(rows: DataFrame, truth: str, pred: str, score: str, item: str, k: int, by: list[str] | None = None) -> DataFrame:
    """The k first items of each true × predicted cell, with their place and the cell's total.

    Highest score first, lowest first in the column predicted normal (0); ties by item. The window keeps only k
    rows a cell on each partition before it shuffles; totals come from an aggregation.
    """
    by = by or []
    sign = F.when(F.col(pred) == 0, F.col(score)).otherwise(-F.col(score))
    cell = [*by, truth, pred]
    w = Window.partitionBy(*cell).orderBy(sign, item)
    top = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(*cell, "place", item, score)
    return top.join(rows.groupBy(*cell).agg(F.count("*").alias("total")), cell)


def dense_gallery(rows: DataFrame, truth: str, pred: str, score: str, item: str, k: int) -> DataFrame:
    """gallery() over every true × predicted cell of the four classes; one without rows has a total of 0 and one empty place."""
    g = gallery(rows, truth, pred, score, item, k)
    dense = grid(rows.sparkSession).select(F.col("truth").alias("_t"), F.col("pred").alias("_p"))
    on = (F.col(truth) == F.col("_t")) & (F.col(pred) == F.col("_p"))
    return dense.join(g, on, "left").select(F.col("_t").alias(truth), F.col("_p").alias(pred), "place", item, score, F.coalesce("total", F.lit(0)).alias("total"))


def unusable(rows: DataFrame, truth: str, score: str, by: list[str]) -> DataFrame:
    """(by..., reason) of runs that no summary can use: without scores, without defects, or with defects only."""
    ok = F.col(score).isNotNull() & ~F.isnan(score) & F.col(truth).isNotNull()
    c = rows.groupBy(*by).agg(F.count(F.when(ok, 1)).alias("_n"), F.count(F.when(ok & (F.col(truth) != 0), 1)).alias("_d"))
    reason = F.when(F.col("_n") == 0, "no scores").when(F.col("_d") == 0, "no defects").when(F.col("_d") == F.col("_n"), "defects only")
    return c.select(*by, reason.alias("reason")).where("reason is not null")


def require_both(rows: DataFrame, truth: str) -> DataFrame:
    """rows, after an action that looks for normal and defect rows: areas and false alarms need both."""
    n, d = rows.agg(F.count(truth), F.sum((F.col(truth) != 0).cast("long"))).first()
    if not n or d in (0, n):
        raise ValueError("no rows" if not n else f"every crop is {'a defect' if d else 'normal'}; areas and false alarms need both")
    return rows


def mistakes(confused: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Non-empty cells off the diagonal with their rank: most rows first, then by truth and prediction."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "truth", "pred") if by else Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "truth", "pred")
    off = confused.where("truth <> pred and n > 0")
    return off.withColumn("rank", F.row_number().over(w)).select(*by, "rank", "truth", "pred", "n")


def accuracy(rows: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    """(by..., accuracy) over rows that have both."""
    return rows.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def weighted_mean(rows: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """(by..., mean): sum of value × weight over the sum of weights; null where the weights add up to nothing."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return rows.groupBy(*by).agg((F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0))).alias("mean"))


def mean_std(rows: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """(by..., n, <v>_mean, <v>_std): NaN and null left out, sample deviation, null below two values."""
    real = {v: F.when(~F.isnan(v), F.col(v)) for v in values}
    aggs = [f for v, c in real.items() for f in (F.avg(c).alias(f"{v}_mean"), F.stddev_samp(c).alias(f"{v}_std"))]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def run_metrics(rows: DataFrame, truth: str, pred: str, score: str, max_miss: float = 0.10, by: list[str] | None = None) -> DataFrame:
    """(by..., macro_recall, normal_recall, auroc, far): a class without rows counts as recall 0; far is NaN if unreachable."""
    by = by or ["run_id"]
    sweep = threshold_sweep(rows, score, F.col(truth) != 0, by)
    r = recalls(confusion(rows, truth, pred, by), by)
    macro = r.groupBy(*by).agg(F.avg("recall").alias("macro_recall"), F.max(F.when(F.col("truth") == 0, F.col("recall"))).alias("normal_recall"))
    point = operating_points(sweep, [max_miss], by).select(*by, F.coalesce("far", F.lit(float("nan"))).alias("far"))
    return macro.join(auroc(sweep, by), by, "left").join(point, by, "left")
