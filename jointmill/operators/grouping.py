"""Groups of photos that show one component: pairs, components, ids, measures, hand-made pairings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.scores import ratio
from jointmill.operators.components import connected_components
from jointmill.operators.windows import global_rank

#: The two viewpoints whose photos are lit from opposite sides.
LIT = ("V2", "V2.1")


def with_components(items: DataFrame, item: str, pairs: DataFrame, a: str = "item_a", b: str = "item_b", root: str = "root") -> DataFrame:
    """items with the root of their component; an item without a pair is its own root."""
    c = connected_components(pairs, a, b).withColumnRenamed("node", item).withColumnRenamed("root", "_r")
    return items.join(c, item, "left").withColumn(root, F.coalesce("_r", item)).drop("_r")


def group_ids(items: DataFrame, root: str, path: str, method: str) -> DataFrame:
    """items with group_id `<method>_NNN` and group_size; groups are numbered by their smallest path, from 1.

    The number of a group is its place among all groups: global_rank() finds it, whatever starts the paths have in common.
    """
    g = items.groupBy(root).agg(F.min(path).alias("_first"), F.count("*").alias("group_size"))
    g = global_rank(g, ["_first", root], "_n")
    digits = F.col("_n").cast("string")
    label = F.concat(F.lit(f"{method}_"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))
    return items.join(g.select(root, label.alias("group_id"), "group_size"), root)


#: Columns of a table of groups, whatever method made it.
GROUP_COLUMNS = (
    "image_name", "dataset_path", "board", "package", "cell", "viewpoint", "component_hint", "method", "threshold", "crop_tolerance", "fingerprint", "group_id", "group_size",
)


def group_rows(grouped: DataFrame, method: str, threshold: float | None = None, tolerance: float | None = None) -> DataFrame:
    """Grouped photos in the columns that all methods share; parameters that don't apply, and missing fingerprints, are blank."""
    have = grouped.columns
    text = lambda v: F.lit("" if v is None else f"{v:g}")
    made = {"method": F.lit(method), "threshold": text(threshold), "crop_tolerance": text(tolerance), "cell": F.concat_ws("/", "board", "package")}
    blank = {c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("") for c in ("component_hint", "fingerprint")}
    return grouped.select(*[(made | blank).get(c, F.col(c) if c in have else F.lit(None)).alias(c) for c in GROUP_COLUMNS])


def manual_rows(images: DataFrame, memberships: DataFrame, path: str = "dataset_path") -> DataFrame:
    """Photos grouped by hand-made sets, in the same columns as any other grouping; a photo of no set is a group of its own.

    memberships: (node, root) as connected_components() gives them.
    """
    m = memberships.select(F.col("node").alias(path), F.col("root").alias("_r"))
    rooted = images.join(m, path, "left").withColumn("_root", F.coalesce("_r", path)).drop("_r")
    return group_rows(group_ids(rooted, "_root", path, "manual"), "manual")


def group_of(memberships: DataFrame, path: str) -> DataFrame:
    """(node, root) of the group that holds the path; no rows if none does."""
    return memberships.join(F.broadcast(memberships.where(F.col("node") == path).select("root").limit(1)), "root").select("node", "root")


def set_edges(sets: DataFrame, members: str) -> DataFrame:
    """(a, b): every set of two or more as a star from its smallest member."""
    s = sets.select(F.array_sort(F.array_distinct(F.filter(members, lambda x: x.isNotNull()))).alias("m")).where(F.size("m") > 1)
    return s.select(F.get("m", F.lit(0)).alias("a"), F.explode("m").alias("b"))


def pair_by_hint(items: DataFrame, cell: str, hint: str, item: str, edges: DataFrame) -> DataFrame:
    """(node, root): hand-made groups, as (a, b) edges, united with the items of one cell that carry the same hint.

    A hint's items are a star from the smallest, so one that many carry adds no more edges than items.
    """
    h = items.where(F.coalesce(F.col(hint), F.lit("")) != "").select(cell, hint, item).distinct()
    hubs = h.groupBy(cell, hint).agg(F.min(item).alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return connected_components(edges.select("a", "b").unionByName(h.join(hubs, [cell, hint]).select("a", F.col(item).alias("b"))))


def cell_columns(items: DataFrame, cell: str, viewpoint: str, item: str) -> DataFrame:
    """(cell, viewpoint, column, place, item): the viewpoints of a cell side by side, each in the order of its items."""
    views = items.where(F.col(cell).isNotNull()).select(cell, viewpoint).distinct()
    views = views.withColumn("column", F.row_number().over(Window.partitionBy(cell).orderBy(viewpoint)))
    w = Window.partitionBy(cell, "column").orderBy(item)
    return items.join(views, [cell, viewpoint]).withColumn("place", F.row_number().over(w)).select(cell, viewpoint, "column", "place", item)


def tag_summary(items: DataFrame, cell: str, viewpoint: str, item: str, memberships: DataFrame) -> DataFrame:
    """One row on hand-made pairing: images, groups, tagged, untagged, pairable, unknown, percent (0.0 where nothing is pairable).

    memberships: (node, root) of the sets; groups with two or more known members count.
    """
    known = items.select(F.col(item).alias("node")).distinct()
    inside = memberships.join(known, "node")
    groups = inside.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"))
    tagged = inside.agg(F.count_distinct("node").alias("tagged"))
    unknown = memberships.join(known, "node", "left_anti").agg(F.count_distinct("node").alias("unknown"))
    sizes = items.groupBy(cell, viewpoint).agg(F.count("*").alias("n")).groupBy(cell).agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("images"), F.coalesce(F.sum(2 * (F.col("n") - F.col("m"))), F.lit(0)).alias("pairable"))
    for one in (groups, tagged, unknown):
        out = out.crossJoin(F.broadcast(one))
    return out.withColumns({"untagged": F.col("images") - F.col("tagged"), "percent": ratio(F.col("tagged") * 100, F.col("pairable"))})


def sweep_at_tolerances(items: DataFrame, item: str, pairs_at: Callable[[float | None], DataFrame], tolerances: list[float | None], score: str, thresholds: list[float], below: bool) -> DataFrame:
    """threshold_sweep() at every crop tolerance, with it in `tolerance`: each has crops, and so features and pairs, of its own.

    pairs_at(tolerance) gives the scored pairs (item_a, item_b, score) of the crops cut with that tolerance, null for the
    whole frame.
    """
    one = lambda t: threshold_sweep(items, item, pairs_at(t), score, thresholds, below).withColumn("tolerance", F.lit(t).cast("double"))
    return reduce(DataFrame.unionByName, [one(t) for t in tolerances])


def size_histogram(items: DataFrame, group: str) -> DataFrame:
    """(size, groups): how many groups have each size."""
    return items.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def spanning(items: DataFrame, group: str, cell: str) -> DataFrame:
    """(group, cells): groups whose items lie in more than one cell."""
    return items.groupBy(group).agg(F.count_distinct(cell).alias("cells")).where("cells > 1")


def partner_ceiling(items: DataFrame, cell: str, viewpoint: str) -> DataFrame:
    """(cell, first, second, most): photos of the two lit viewpoints in cells that have both, and how many could have a partner."""
    p = items.groupBy(cell).agg(F.sum((F.col(viewpoint) == LIT[0]).cast("long")).alias("first"), F.sum((F.col(viewpoint) == LIT[1]).cast("long")).alias("second"))
    return p.where("first > 0 and second > 0").withColumn("most", 2 * F.least("first", "second"))


def measured(items: DataFrame, group: list[str], cell: str, viewpoint: str, hint: str, by: list[str] | None = None) -> DataFrame:
    """(by..., items, groups, largest, singletons, violations, references, merged, partnered, ceiling, ...) of a grouping.

    violations are groups over several cells; references the (cell, hint) that hold exactly two items, merged those
    whose two share a group. partnered counts the items of cells with both lit viewpoints whose group holds the other one.
    `by` splits the items into separate groupings, such as one a threshold.
    """
    by = by or []
    per = items.groupBy(*by, *group).agg(
        F.count("*").alias("n"), F.count_distinct(cell).alias("cells"),
        F.sum((F.col(viewpoint) == LIT[0]).cast("long")).alias("a"), F.sum((F.col(viewpoint) == LIT[1]).cast("long")).alias("b"),
    )
    totals = per.groupBy(*by).agg(
        F.sum("n").alias("items"), F.count("*").alias("groups"), F.max("n").alias("largest"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"),
        F.sum((F.col("cells") > 1).cast("long")).alias("violations"), F.sum(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("a") + F.col("b")).otherwise(0)).alias("partnered"),
    )
    ref = items.where(F.coalesce(F.col(hint), F.lit("")) != "").groupBy(*by, cell, hint).agg(F.count("*").alias("n"), F.count_distinct(*group).alias("k")).where("n = 2")
    ref = ref.groupBy(*by).agg(F.count("*").alias("references"), F.sum((F.col("k") == 1).cast("long")).alias("merged"))
    lit = items.groupBy(*by, cell).agg(F.sum((F.col(viewpoint) == LIT[0]).cast("long")).alias("x"), F.sum((F.col(viewpoint) == LIT[1]).cast("long")).alias("y"))
    lit = lit.groupBy(*by).agg(F.sum(2 * F.least("x", "y")).alias("ceiling"), F.sum(F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("x") + F.col("y")).otherwise(0)).alias("cross_lit"))
    one = totals
    for other in (ref, lit):
        one = one.join(other, by, "left") if by else one.crossJoin(F.broadcast(other))
    one = one.na.fill(0, ["references", "merged", "ceiling", "cross_lit"])
    return one.withColumn("partner_rate", ratio(F.col("partnered"), F.col("cross_lit")))


def best_row(metrics: DataFrame, threshold: str) -> DataFrame:
    """The threshold that merges most references, then has the smallest largest group, then the smallest threshold."""
    return metrics.orderBy(F.desc("merged"), "largest", threshold).limit(1)


def threshold_sweep(items: DataFrame, item: str, scored_pairs: DataFrame, score: str, thresholds: list[float], below: bool) -> DataFrame:
    """items × thresholds with the root of their component at each threshold.

    Pairs are scored once; components of all thresholds are found together, on nodes of threshold and item. `below`
    takes pairs with a score of at most the threshold, else of at least.
    """
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    node = lambda c: F.struct(F.col("threshold").alias("t"), F.col(c).alias("i"))
    p = scored_pairs.select("item_a", "item_b", score, t).where(F.col(score) <= F.col("threshold") if below else F.col(score) >= F.col("threshold"))
    c = connected_components(p.select(node("item_a").alias("a"), node("item_b").alias("b")))
    c = c.select(F.col("node.t").alias("threshold"), F.col("node.i").alias(item), F.col("root.i").alias("_r"))
    return items.select("*", t).join(c, ["threshold", item], "left").withColumn("root", F.coalesce("_r", item)).drop("_r")


def canonical_groups(sets: DataFrame, members: str) -> DataFrame:
    """(root, members): overlapping sets united, sets below two members dropped, members sorted.

    A group is one row, so one that a person made. Of groups without a bound, take connected_components() of set_edges(), a
    row a member.
    """
    s = sets.select(F.array_sort(F.array_distinct(F.filter(members, lambda x: x.isNotNull()))).alias("m")).where(F.size("m") > 1)
    edges = s.select(F.get("m", F.lit(0)).alias("a"), F.explode("m").alias("b"))
    return connected_components(edges).groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("members")).where(F.size("members") > 1)


def linked(groups: DataFrame, a: str, b: str) -> DataFrame:
    """groups with a and b together; the same item twice changes nothing."""
    extra = groups.sparkSession.createDataFrame([(a, [a, b])], "root string, members array<string>")
    return groups if a == b else canonical_groups(groups.select("root", "members").unionByName(extra), "members")


def unlinked(groups: DataFrame, item: str) -> DataFrame:
    """groups without the item; what is left alone is no group."""
    g = groups.withColumn("members", F.filter("members", lambda x: x != item)).where(F.size("members") > 1)
    return g.withColumn("root", F.get("members", F.lit(0)))


def without_cell(groups: DataFrame, cell_items: Column) -> DataFrame:
    """groups that have a member outside the cell's items (an array column or literal)."""
    return groups.where(F.size(F.array_except("members", cell_items)) > 0)


def unknown_members(groups: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Distinct members that are no item."""
    return groups.select(F.explode("members").alias(item)).distinct().join(items.select(item), item, "left_anti")


def hint_groups(items: DataFrame, cell: str, hint: str, item: str) -> DataFrame:
    """(cell, hint, members) of two or more items with the same non-empty hint in one cell; pair_by_hint() has a row a member."""
    g = items.where(F.coalesce(F.col(hint), F.lit("")) != "").groupBy(cell, hint).agg(F.array_sort(F.collect_set(item)).alias("members"))
    return g.where(F.size("members") > 1)


def guessed_pairs(items: DataFrame, cell: str, viewpoint: str, order: list[str], item: str, tagged: DataFrame | None = None) -> DataFrame:
    """(cell, place, left_item, right_item): photos at the same place of a cell's first two viewpoints, both untagged.

    Places are counted before tagged photos are left out, as a photo keeps its place in the tray.
    """
    views = Window.partitionBy(cell).orderBy(viewpoint)
    v = items.select(cell, viewpoint).distinct().withColumn("_v", F.row_number().over(views)).where("_v <= 2")
    w = Window.partitionBy(cell, viewpoint).orderBy(*order)
    n = items.join(v, [cell, viewpoint]).withColumn("place", F.row_number().over(w))
    side = lambda k, name: n.where(F.col("_v") == k).select(cell, "place", F.col(item).alias(name))
    pairs = side(1, "left_item").join(side(2, "right_item"), [cell, "place"])
    if tagged is None:
        return pairs
    for c in ("left_item", "right_item"):
        pairs = pairs.join(tagged.select(F.col(item).alias(c)).distinct(), c, "left_anti")
    return pairs.select(cell, "place", "left_item", "right_item")


def tag_progress(items: DataFrame, cell: str, viewpoint: str, item: str, tagged: DataFrame) -> DataFrame:
    """(cell, items, balanced, pairable, tagged, percent) of hand-made pairing in each cell.

    pairable is twice the photos outside the largest viewpoint; percent is 0.0 where nothing is.
    """
    t = tagged.select(item).distinct().withColumn("_t", F.lit(1))
    per = items.join(t, item, "left").groupBy(cell, viewpoint).agg(F.count("*").alias("n"), F.count("_t").alias("t"))
    c = per.groupBy(cell).agg(F.sum("n").alias("items"), (F.min("n") == F.max("n")).alias("balanced"), (2 * (F.sum("n") - F.max("n"))).alias("pairable"), F.sum("t").alias("tagged"))
    return c.withColumn("percent", ratio(F.col("tagged") * 100, F.col("pairable")))
