"""One surviving record for every joint, from records that disagree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.geometry import bbox, rectangle
from jointmill.functions.labels import PRECEDENCE, class_at, joint_class, position_name, precedence
from jointmill.functions.paths import board_of, plain_path, trimmed
from jointmill.operators.joins import skew_safe_lookup
from jointmill.session import dropped, written

#: Records of one photo whose x-centres are less than this apart describe one joint.
APART = 200.0
#: Pseudo-counts of right and wrong statements each source starts with.
PRIOR = (4.0, 1.0)
_FIELDS = ("image_name", "dataset_path", "board", "package", "viewpoint", "light_direction", "capture_timestamp", "raw_label", "annotator", "origin")


def _photo_key(prefix: str) -> Column:
    """Half of a 128-bit key of the photo; a photo with an unknown part goes by its path, else by the record."""
    parts = F.to_json(F.struct("board", "package", "viewpoint", F.lower("image_name").alias("n")))
    known = F.col("board").isNotNull() & F.col("package").isNotNull() & F.col("viewpoint").isNotNull() & F.col("image_name").isNotNull()
    by = F.when(known, F.concat(F.lit("photo"), parts)).otherwise(F.coalesce(F.concat(F.lit("path"), F.col("path")), F.concat(F.lit("record"), F.col("record_id").cast("string"))))
    return F.xxhash64(F.lit(prefix), by)


def statements(polygons: DataFrame) -> DataFrame:
    """Records with their photo, box, stated class and set of stated classes as bits in merge order."""
    p = polygons.where("record_id is not null").select(
        "record_id", *[c for c in _FIELDS if c not in ("board", "dataset_path")], board_of("board", "dataset_path").alias("board"), plain_path("dataset_path").alias("path"),
        "class", "merged_from", "updated_at", bbox("points").alias("box"),
    )
    names = F.transform(F.split(F.coalesce("merged_from", F.lit("")), r"\+"), joint_class)
    single = F.coalesce(joint_class("class"), joint_class("raw_label"), F.get(names, F.lit(0)))
    bits = F.lit(0)
    for i, name in enumerate(PRECEDENCE):
        bits = bits + F.when(F.coalesce(single == name, F.lit(False)) | F.coalesce(F.array_contains(names, name), F.lit(False)), 1 << i).otherwise(0)
    source = F.concat_ws("/", F.coalesce(trimmed("annotator"), F.lit("?")), F.coalesce(trimmed("origin"), F.lit("?")))
    p = p.withColumns({"pa": _photo_key("a"), "pb": _photo_key("b"), "place": precedence(single), "bits": bits, "source": source, "x": (F.col("box.x0") + F.col("box.x1")) / 2})
    return p.withColumnRenamed("path", "dataset_path").drop("class", "merged_from")


def _joints(cells: DataFrame) -> DataFrame:
    """Cells with the number of their joint in the photo, from the left, and the number of joints.

    Two records of one cell are less than APART apart, so cells in the order of x decide by the gaps between them.
    A photo has as many cells as APART fits into its width, however many records it has.
    """
    photo = Window.partitionBy("pa", "pb").orderBy("cell")
    gap = F.col("x_min") - F.lag("x_max").over(photo)
    starts = F.when(gap.isNull() | (gap >= APART), 1).otherwise(0)
    numbered = cells.withColumn("starts", starts).withColumn("joint", F.sum("starts").over(photo.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.withColumn("joints", F.max("joint").over(Window.partitionBy("pa", "pb"))).drop("starts")


def _per_joint(records: DataFrame, cell_aggs: dict[str, Column], joint_aggs: dict[str, Column]) -> DataFrame:
    """Aggregates by cell, then by joint: two steps, so no photo or joint has to fit into one task."""
    placed = records.where("x is not null and not isnan(x)").withColumn("cell", F.floor(F.col("x") / APART))
    base = {"x_min": F.min("x"), "x_max": F.max("x"), "first_id": F.min("record_id"), "last_id": F.max("record_id"), "place": F.min("place")}
    cells = placed.groupBy("pa", "pb", "cell").agg(*[a.alias(k) for k, a in {**base, **cell_aggs}.items()])
    over = {"set_id": F.min("first_id"), "several": F.min("first_id") < F.max("last_id"), "place": F.min("place"), "joints": F.max("joints")}
    return _joints(cells).groupBy("pa", "pb", "joint").agg(*[a.alias(k) for k, a in {**over, **joint_aggs}.items()])


def _said(name: str = "claims") -> dict[str, Column]:
    return {name: F.collect_set(F.when(F.col("bits") > 0, F.struct("source", "bits")))}


def _merged() -> dict[str, Column]:
    return {"claims": F.array_sort(F.array_distinct(F.flatten(F.collect_list("claims"))))}


def _judged(claims: DataFrame, keys: list[str], quality: DataFrame, prior: list[float], total: int, keep: list[Column] | None = None) -> DataFrame:
    """(keys..., p0 .. p3[, kept]): for every joint or pattern the probability that it shows each class.

    claims: `total` rows, one a claim, with source and bits. Every claim is weighed by its source's row in quality, whose
    `claims` counts them; a source with more than a task takes is looked up by a broadcast of the few such sources.
    """
    c = skew_safe_lookup(claims, quality.select("source", "if_said", "if_not", "claims"), "source", "claims", total)
    says = [F.shiftright("bits", v).bitwiseAND(F.lit(1)) == 1 for v in range(len(PRECEDENCE))]
    z = [(F.lit(math.log(prior[v] / (1 - prior[v]))) + F.sum(F.when(says[v], F.col("if_said")).otherwise(F.col("if_not")))) for v in range(len(PRECEDENCE))]
    p = [1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(60.0)), F.lit(-60.0)))) for x in z]
    return c.groupBy(*keys).agg(*[x.alias(f"p{v}") for v, x in enumerate(p)], *(keep or []))


def _weighed(quality: DataFrame) -> DataFrame:
    """quality with the log odds that a statement, and the lack of one, adds."""
    return quality.withColumns({"if_said": F.log(F.col("sensitivity") / (1 - F.col("specificity"))), "if_not": F.log((1 - F.col("sensitivity")) / F.col("specificity"))})


def source_quality(patterns: DataFrame, settled: float = 1e-3, most: int = 1000) -> tuple[DataFrame, list[float]]:
    """((source, claims, joints, sensitivity, specificity, if_said, if_not), share of each class), by expectation-maximisation.

    patterns: claims (array of source and bits) and n, the number of joints with exactly these claims. Every class is
    a yes-or-no fact of its own, so a joint may show several. A round judges the patterns by the qualities of their
    sources and counts the sources' right and wrong statements anew; qualities stay a table, one row a source, however many
    there are. Rounds go on until no quality and no share moves by more than `settled`; should they not settle within `most`
    rounds, it raises rather than pass off what it has. Sources start at 0.8 and 0.9; without claims the table is empty.
    """
    good, bad = PRIOR
    k = range(len(PRECEDENCE))
    each = written(patterns.select(F.xxhash64("claims").alias("pa"), F.xxhash64(F.lit(1), "claims").alias("pb"), "n", F.explode("claims").alias("c")).select("pa", "pb", "n", "c.source", "c.bits"), "claims")
    quality = each.groupBy("source").agg(F.sum("n").alias("joints"), F.count("*").alias("claims")).withColumns({"sensitivity": F.lit(0.8), "specificity": F.lit(0.9)})
    quality, prior = written(_weighed(quality), "quality"), [0.3] * len(PRECEDENCE)
    last = quality
    joints, total = patterns.agg(F.sum("n")).first()[0] or 0, each.count()
    for _ in range(most if joints else 0):
        # a row of its own, without a source, counts each pattern once for the shares of the classes
        whole = F.array(F.struct(F.lit(None).cast("string").alias("source"), F.lit(0).alias("bits")))
        judged = _judged(each, ["pa", "pb", "n"], quality, prior, total, [F.concat(F.collect_list(F.struct("source", F.col("bits").cast("int").alias("bits"))), whole).alias("c")])
        open_ = judged.select("n", *[f"p{v}" for v in k], F.explode("c").alias("c"))
        said = [F.shiftright("c.bits", v).bitwiseAND(F.lit(1)) for v in k]
        weight = lambda x: F.sum(F.col("n") * sum((x(v) for v in k), F.lit(0.0)))
        sums = open_.groupBy(F.col("c.source").alias("source")).agg(
            weight(lambda v: F.col(f"p{v}") * said[v]).alias("tp"), weight(lambda v: F.col(f"p{v}")).alias("pos"),
            weight(lambda v: (1 - F.col(f"p{v}")) * (1 - said[v])).alias("tn"), weight(lambda v: 1 - F.col(f"p{v}")).alias("neg"), F.count("*").alias("claims"), F.sum("n").alias("joints"),
            *[(F.sum(F.col("n") * F.col(f"p{v}")) / joints).alias(f"s{v}") for v in k],
        )
        share = F.struct(*[f"s{v}" for v in k]).alias("share")
        new = sums.select("source", "claims", "joints", ((F.col("tp") + good) / (F.col("pos") + good + bad)).alias("sensitivity"), ((F.col("tn") + good) / (F.col("neg") + good + bad)).alias("specificity"), share)
        far = lambda c: F.abs(F.col(f"new.{c}") - F.col(f"old.{c}"))
        both = new.alias("new").join(quality.alias("old"), "source", "left").select("new.*", F.greatest(far("sensitivity"), far("specificity")).alias("moved"))
        table = written(_weighed(both), "quality")
        moved, share = table.agg(F.max("moved"), F.max(F.when(F.col("source").isNull(), F.col("share")))).first()
        shares = [min(0.99, max(0.01, share[f"s{v}"])) for v in k]
        moved = max(moved, *(abs(a - b) for a, b in zip(shares, prior, strict=True)))
        dropped(last)
        last, quality, prior = table, table.where("source is not null").drop("share", "moved"), shares
        if moved < settled:
            break
    else:
        if joints:
            raise RuntimeError(f"the sources' qualities did not settle in {most} rounds")
    dropped(each)
    return quality, prior


def learned(polygons: DataFrame) -> tuple[DataFrame, list[float]]:
    """source_quality() of the records of all joints."""
    claims = _per_joint(statements(polygons).select("pa", "pb", "x", "record_id", "place", "source", "bits"), _said(), _merged()).where(F.size("claims") > 0)
    patterns = written(claims.groupBy("claims").agg(F.count("*").alias("n")), "patterns")
    found = source_quality(patterns)
    dropped(patterns)
    return found


def survivors(polygons: DataFrame) -> DataFrame:
    """One row a joint: the best its records offer, field by field.

    Records of a photo whose x-centres are less than 200 apart are chained into one joint. A latent two-sided quality
    model learns each source's (annotator and origin) sensitivity and specificity from all joints. `merged_from`, which
    may hold several classes, keeps every class judged true (probability 0.5 or more) and the stated `class`, in merge order. `class` is the first
    class in merge order that a record states, as records are merged everywhere, whatever the model says; `judged` is
    the likeliest class by the model alone. Other fields come from the record of the most trusted source that
    has the field, then the latest, then the one with the largest id; `points` is the union box, `updated_at` the
    latest, rank, position and count are counted anew from left to right.

    Defined results: rows delivered twice count once; where no record states a class, class, judged and merged_from are
    null; records without usable points share
    no joint and come out alone with a null rank; rows with a null record_id are no records. A null in any field is only
    overruled, never an obstacle. An empty table gives an empty result.
    """
    records = statements(polygons)
    quality, prior = learned(polygons)
    sizes = written(records.groupBy("source").agg(F.count("*").alias("rows")), "sources")
    trust = sizes.join(quality, "source", "left").select("source", "rows", F.coalesce(F.col("sensitivity") + F.col("specificity") - 1, F.lit(-1.0)).alias("trust"))
    trust = written(trust, "trust")  # of known size, so few sources reach the records without shuffling these
    records = skew_safe_lookup(records, trust, "source", "rows", sizes.agg(F.sum("rows")).first()[0] or 0)
    order = [F.col("trust").alias("t"), F.col("updated_at").alias("u"), F.col("record_id").alias("r")]
    best = {f: F.max(F.when(trimmed(f) != "", F.struct(*order, F.col(f).alias("v")))) for f in _FIELDS}
    box = {"bx0": F.min("box.x0"), "by0": F.min("box.y0"), "bx1": F.max("box.x1"), "by1": F.max("box.y1"), "updated": F.max("updated_at")}
    again = {f: F.max(f) for f in _FIELDS} | {k: (F.min(k) if k in ("bx0", "by0") else F.max(k)) for k in box} | _merged()
    each = _per_joint(records, best | box | _said(), again)
    each = written(each.withColumns({f: F.col(f"{f}.v") for f in _FIELDS}), "joints")  # what a value won by goes no further
    claims = each.select("pa", "pb", "joint", F.explode("claims").alias("c")).select("pa", "pb", "joint", "c.source", "c.bits")
    claimed = quality.withColumn("claims", F.col("joints"))
    judged = _judged(claims, ["pa", "pb", "joint"], claimed, prior, claimed.agg(F.sum("claims")).first()[0] or 0)
    p = [F.col(f"p{v}") for v in range(len(PRECEDENCE))]
    truth = F.array_compact(F.array(*[F.when((p[i] >= 0.5) | (F.col("place") == i), name) for i, name in enumerate(PRECEDENCE)]))
    likeliest = F.array_position(F.array(*p), F.greatest(*p)) - 1
    rank = F.col("joint")
    out = each.join(judged, ["pa", "pb", "joint"], "left").select(
        "set_id", "several", class_at("place").alias("class"), class_at(likeliest).alias("judged"), F.nullif(F.array_join(truth, "+"), F.lit("")).alias("merged_from"), rank.alias("polygon_rank_x"),
        F.col("joints").alias("polygon_count"), F.when(rank == 1, "left").otherwise(position_name(rank, F.col("joints"))).alias("joint_position"),
        *_FIELDS, rectangle(F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1")).alias("points"), F.col("updated").alias("updated_at"),
    )
    alone = records.where("x is null or isnan(x)").groupBy("record_id").agg(F.min("place").alias("place"), F.max("updated_at").alias("updated_at"), *[F.max(f).alias(f) for f in _FIELDS])
    none = lambda t: F.lit(None).cast(t)
    alone = alone.select(
        F.col("record_id").alias("set_id"), F.lit(False).alias("several"), class_at("place").alias("class"), class_at("place").alias("judged"), class_at("place").alias("merged_from"), none("int").alias("polygon_rank_x"),
        none("int").alias("polygon_count"), none("string").alias("joint_position"), *_FIELDS, none("array<array<double>>").alias("points"), "updated_at",
    )
    return out.unionByName(alone)
