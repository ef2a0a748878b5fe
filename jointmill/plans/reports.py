"""Markdown reports from small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.labels import CLASSES
from jointmill.functions.scores import ratio
from jointmill.operators import grouping
from jointmill.operators.windows import global_rank
from jointmill.plans.options import markdown, mean_std_text

#: Miss rates at which an evaluation reports its operating points, and the largest group a usable grouping may have.
LIMITS, TIGHT = (0.10, 0.05, 0.0), 4


def section(title: str, text: str) -> str:
    return f"## {title}\n\n{text}\n"


def audit_report(tables: dict[str, DataFrame]) -> str:
    """Report of pipelines.audit(): a section a table, each ordered by its columns."""
    titles = {
        "extensions": "Files by extension", "folders": "Photos by folder", "layouts": "Annotation layouts", "labels": "Labels", "cells": "Cells", "mirrored": "Names in several folders",
        "coverage": "Joint photos by cell", "brightness": "Brightness by board and setup", "duplicates": "Sample of duplicates", "locations": "Places of annotated photos", "tokens": "Name tokens", "segments": "Path segments", "outliers": "Names of another length", "unreadable": "Files without annotations",
    }
    show = {"outliers": ["path", "n_tokens"]}
    parts = [section(t, markdown(d := tables[k].select(*show[k]) if k in show else tables[k], d.columns[:2])) for k, t in titles.items() if k in tables]
    return "# Inventory\n\n" + "\n".join(parts)


def evaluation_report(name: str, found: dict[str, DataFrame]) -> str:
    """Report of pipelines.evaluate() of one run: classes, confusion, areas, operating points at the fixed limits."""
    from jointmill.operators.metrics import operating_points

    label = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("truth") + 1)
    recall = found["recalls"].select(label.alias("class"), "support", "recall", "precision", "f1", "truth")
    wide = found["confusion"].groupBy("truth").pivot("pred", list(range(len(CLASSES)))).agg(F.sum("n")).select(label.alias("true"), *[F.col(f"`{i}`").alias(c) for i, c in enumerate(CLASSES)], "truth")
    points = operating_points(found["sweep"], list(LIMITS), ["all"]).select("max_miss", "threshold", "miss", "far")
    areas = found["auroc"].join(found["auprc"], "all").select("auroc", "auprc")
    parts = [section("Classes", markdown(recall.drop("truth"), ["class"])), section("Confusion", markdown(wide.drop("truth"), ["true"])), section("Areas", markdown(areas, ["auroc"])), section("Operating points", markdown(points, ["max_miss"]))]
    return f"# Evaluation of {name}\n\n" + "\n".join(parts)


def summary_report(runs: DataFrame, values: list[str], option: str = "option", seed: str = "seed") -> str:
    """One line an option: its seeds and mean ± deviation of every value, runs without the value counted apart."""
    real = {v: F.when(~F.isnan(v), F.col(v)) for v in values}
    aggs = [a for v, c in real.items() for a in (F.avg(c).alias(f"{v}_m"), F.stddev_samp(c).alias(f"{v}_s"), F.count(c).alias(f"{v}_n"))]
    rows = runs.groupBy(option).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(seed).cast("string"))), ", ").alias("seeds"), *aggs).orderBy(option).collect()
    lines = [f"| option | seeds | {' | '.join(values)} |", "|" + " --- |" * (2 + len(values))]
    for r in rows:
        cells = [mean_std_text(r[f"{v}_m"], r[f"{v}_s"], r["n"], r[f"{v}_n"]) for v in values]
        lines.append(f"| {r[option]} | {r['n']} ({r['seeds']}) | {' | '.join(cells)} |")
    return "\n".join(lines)


def split_report(counts: DataFrame, margins: DataFrame, meta: dict) -> str:
    """Section on a frozen split: counts by split, slack of the gates, how it was chosen."""
    chosen = "\n".join(f"- {k}: {meta[k]}" for k in sorted(meta))
    return section("Split", markdown(counts, ["split"])) + "\n" + section("Gates", markdown(margins, ["slack", "split"])) + "\n" + section("Choice", chosen)


def verdict(swept: DataFrame, threshold: str = "threshold", tolerance: str = "tolerance") -> str:
    """Whether a swept grouping separates components: a best row's largest group holds no more than four photos.

    Where the sweep was made at several crop tolerances, each has a best row, and the tightest of them counts.
    """
    several = tolerance in swept.columns
    every = swept.select(tolerance).distinct().collect() if several else [None]  # as many as someone swept
    best = [grouping.best_row(swept if t is None else swept.where(F.col(tolerance).eqNullSafe(F.lit(t[0]))), threshold).first() for t in every]
    best = [b for b in best if b is not None]
    if not best:
        return "nothing was swept"
    row = min(best, key=lambda b: (b["largest"], b[threshold]))
    at = f"tolerance {row[tolerance]:g}, " if several and row[tolerance] is not None else ""
    said = f"{at}threshold {row[threshold]:g}: {row['merged']} of {row['references']} reference pairs, largest group {row['largest']}"
    return f"usable at {said}" if row["largest"] <= TIGHT else f"no setting separates components; the best is {said}"


def grouping_report(method: str, swept: DataFrame, chosen: DataFrame | None = None) -> str:
    """Report on a grouping method: verdict, sweep, and the chosen grouping's measures with its group sizes."""
    parts = [section("Verdict", verdict(swept)), section("Thresholds", markdown(swept, ["threshold"]))]
    if chosen is not None:
        parts.append(section("Sizes", markdown(grouping.size_histogram(chosen, "group_id"), ["size"])))
    return f"# Grouping by {method}\n\n" + "\n".join(parts)


def sheets(rows: DataFrame, order: list[str], per_sheet: int = 24, by: list[str] | None = None) -> DataFrame:
    """rows with the sheet and tile they are drawn on, counted from 1 within `by`, whose rows a person means to look at."""
    at = F.col("_at") - 1
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if by else global_rank(rows, order, "_at")
    return placed.withColumn("sheet", (F.floor(at / per_sheet) + 1).cast("int")).withColumn("tile", (at % per_sheet + 1).cast("int")).drop("_at")


def crop_set_text(manifest: DataFrame, split_hash: str) -> str:
    """What a set of crops holds, as text: its size, classes by number, splits and the hash of the split."""
    n = {c: {r[c]: r["n"] for r in manifest.groupBy(c).agg(F.count("*").alias("n")).collect()} for c in ("label", "split")}
    classes = ", ".join(f"{k} {v}" for k, v in sorted(n["label"].items(), key=lambda x: (-x[1], x[0])))
    parts = ", ".join(f"{s} {n['split'][s]}" for s in ("train", "val", "test") if s in n["split"])
    return f"{sum(n['label'].values())} crops, one file a joint.\n\nClasses: {classes}\nSplits: {parts}\nSplit hash: {split_hash}\n"


def roc_points(sweep: DataFrame) -> DataFrame:
    """(far, hit, threshold) of a sweep from the origin on; the points a curve is drawn through."""
    start = sweep.sparkSession.createDataFrame([(0.0, 0.0, None)], "far double, hit double, threshold double")
    return start.unionByName(sweep.select("far", (1 - F.col("miss")).alias("hit"), F.col("threshold").cast("double").alias("threshold")))


def share_table(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column."""
    c = rows.groupBy(column).agg(F.count("*").alias("n"))
    return c.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))))
