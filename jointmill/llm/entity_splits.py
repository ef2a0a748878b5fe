"""Splits that keep related records together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointmill.functions.labels import joint_class
from jointmill.functions.paths import board_of, component_number, plain_path, trimmed
from jointmill.llm.feistel import digest_number
from jointmill.operators.components import connected_components
from jointmill.operators.joins import many_to_many, skew_safe_lookup
from jointmill.session import dropped, written


def entity(kind: str, *parts: Column) -> Column:
    """128-bit key of an entity; null if any of its parts is null or blank, so that unknowns never match.

    Two entities of 10**12 share a key with odds of about 10**-15.
    """
    known = reduce(lambda a, b: a & b, [p.isNotNull() & (trimmed(p.cast("string")) != "") for p in parts])
    return F.when(known, F.struct(F.xxhash64(F.lit(kind), *parts).alias("a"), F.xxhash64(F.lit(f"{kind} again"), *parts).alias("b")))


def photo_facts(photos: DataFrame) -> DataFrame:
    """One row a row of photos: photo_id, path, board, package, viewpoint, lower-case name, group_id, component number."""
    return photos.select(
        "photo_id", plain_path("dataset_path").alias("path"), board_of("board", "dataset_path").alias("board"), "package", "viewpoint", F.lower("image_name").alias("name"),
        F.nullif(trimmed("group_id"), F.lit("")).alias("group_id"), component_number("component_hint", "image_name").alias("number"),
    )


def photo_components(photos: DataFrame, tag_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos: photo_id, path, group_id, component; roots: node, root): photos with their component.

    Photos are joined by a shared group_id, inner array of member_groups, same-photo key (board, package, viewpoint,
    image name whatever its case) or component number within board and package. Every row is a node by a number of its
    own. An entity becomes a star from its smallest row to the others, so one of a million photos adds a million edges,
    not pairs, and one of a single photo none. The stars then go through alternating large-star and small-star. A component
    is named by the smallest path in it (by the smallest photo_id where all paths are null), which no partitioning changes.

    Defined results: a photo whose same-photo key has an unknown part stands for itself by its path, without a path by its
    photo_id, without either alone. Tag members that are no photo link nothing; repeated rows are one photo.
    """
    own = F.coalesce(entity("photo", F.col("board"), F.col("package"), F.col("viewpoint"), F.col("name")), entity("path", F.col("path")), entity("id", F.col("photo_id")))
    p = photo_facts(photos).select(
        F.monotonically_increasing_id().alias("node"), "photo_id", "path", "group_id",
        F.array_compact(F.array(own, entity("group", F.col("group_id")), entity("number", F.col("board"), F.col("package"), F.col("number")))).alias("keys"),
    )
    p = written(p, "photos")
    sets = tag_pairs.select(F.explode("member_groups").alias("m")).where("m is not null")
    sets = sets.select(F.array_sort(F.array_distinct(F.filter(F.transform("m", plain_path), lambda x: x.isNotNull()))).alias("m")).where(F.size("m") > 1)
    sets = sets.select(F.struct(F.xxhash64(F.lit("tag"), "m").alias("a"), F.xxhash64(F.lit("tag again"), "m").alias("b")).alias("key"), F.explode("m").alias("path")).distinct()
    tagged = p.select("path", "node").join(sets, "path").select("node", "key")
    rows = p.select("node", F.explode("keys").alias("key")).unionByName(tagged)
    hubs = written(rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    total = hubs.agg(F.sum("n")).first()[0] or 0
    edges = skew_safe_lookup(rows, hubs, "key", "n", total).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    roots = written(connected_components(edges), "components")
    dropped(hubs)
    rooted = p.drop("keys").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.coalesce(F.min("path"), F.concat(F.lit("photo "), F.min("photo_id").cast("string")), F.concat(F.lit("row "), F.col("root").cast("string"))).alias("component"), F.count("*").alias("n"))
    named = skew_safe_lookup(rooted.select("root", "photo_id", "path", "group_id"), names, "root", "n", total + 1)
    return named.drop("root"), roots


def component_groups(photos: DataFrame) -> DataFrame:
    """(group_id, component): every group_id with its component, one row each; grows with the groups, not their pairs."""
    return photos.where("group_id is not null").select("group_id", "component").distinct()


def linked_groups(photos: DataFrame) -> DataFrame:
    """(group_id_a, group_id_b), a < b, of every two different group ids in one component. The output is the pairs.

    Where a component holds so many groups that its pairs would burden one task, they are made by many.
    """
    g = component_groups(photos)
    many = g.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    g = written(g.join(many, "component", "left_semi"), "groups")
    a, b = g.withColumnRenamed("group_id", "group_id_a"), g.withColumnRenamed("group_id", "group_id_b")
    return many_to_many(a, b, ["component"]).where("group_id_a < group_id_b").select("group_id_a", "group_id_b")


def _split_at(component: Column, turn: Column, seed: int, shares: dict[str, float]) -> Column:
    """Split whose range of 0..1 holds the component's hash of this turn: two halves of one MD5, stepped by the turn."""
    text = F.concat(F.lit(f"{seed}:"), component)
    first, step = digest_number(text, 13), digest_number(text, 13, 14)
    u = F.pmod(first + step * turn, F.lit(1 << 52)).cast("double") / float(1 << 52)
    total, upto, out = sum(shares.values()), 0.0, None
    names = list(shares)
    for s in names[:-1]:
        upto += shares[s] / total
        out = F.when(u < upto, s) if out is None else out.when(u < upto, s)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def entity_splits(records: DataFrame, component: str, label: str, shares: dict[str, float], candidates: int = 32, seed: int = 0) -> DataFrame:
    """records with a `split`: all rows of one component in one split, by hashing the component into share-wide ranges.

    Of `candidates` (at most 2048) hashes the one is taken whose splits deviate least from the wanted shares, over all rows
    and over the rows of each label, summed and rounded to 9 digits; ties go to the earliest. They are all judged in one
    aggregation over components and labels. A component holding more rows than a split's share can't be cut, so the
    shares are then missed. Rows with a null component are each on their own, by the hash of the whole row, so copies
    stay together. A `split` column that is there already is replaced; an empty table stays empty.
    """
    if not 0 < candidates <= 2048:
        raise ValueError("1 to 2048 candidates")
    others = [F.col(f"`{c}`") for c in records.columns]
    keyed = records.withColumn("_c", F.coalesce(F.col(component).cast("string"), F.xxhash64(*others).cast("string")))
    sizes = keyed.groupBy("_c", F.col(label).alias("_l")).agg(F.count("*").alias("n"))
    tried = sizes.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    tried = tried.groupBy("s", "_l", _split_at(F.col("_c"), F.col("s"), seed, shares).alias("split")).agg(F.sum("n").alias("n"))
    dense = tried.groupBy("s", "_l").pivot("split", list(shares)).agg(F.sum("n")).na.fill(0, list(shares))
    rows = sum((F.col(k) for k in shares), F.lit(0))
    off = sum((F.abs(F.col(k) / F.greatest(rows, F.lit(1)) - F.lit(v / sum(shares.values()))) for k, v in shares.items()), F.lit(0.0))
    by_label = dense.groupBy("s").agg(F.sum(off).alias("off"), *[F.sum(k).alias(k) for k in shares])
    best = by_label.orderBy(F.round(F.col("off") + off, 9).asc(), "s").select("s").first()
    return keyed.withColumn("split", _split_at(F.col("_c"), F.lit(best[0] if best else 0), seed, shares)).drop("_c")


def crop_records(crops: DataFrame, photos: DataFrame) -> DataFrame:
    """Distinct crops with class and component of their photo; a crop whose photo is unknown stands for its path."""
    c = crops.select(plain_path("dataset_path").alias("path"), trimmed(F.col("polygon_rank_x").cast("string")).alias("rank"), joint_class("class_name").alias("class_name"), "group_id")
    c = c.groupBy("path", "rank").agg(F.min("class_name").alias("class_name"), F.min("group_id").alias("group_id"))
    at = photos.groupBy("path").agg(F.min("component").alias("component"))
    c = c.join(at, "path", "left")
    return c.select(F.concat("path", F.lit("#"), "rank").alias("crop_id"), "group_id", "class_name", F.coalesce("component", "path").alias("component"))
