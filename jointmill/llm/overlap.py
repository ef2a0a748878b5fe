"""Same or near-same photos on both sides of a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointmill.functions.labels import split_name
from jointmill.functions.paths import board_of, component_number, plain_path, trimmed
from jointmill.functions.scores import fingerprint_hex, print_words
from jointmill.operators.joins import many_to_many
from jointmill.operators.similarity import near_classes, print_class
from jointmill.session import dropped, written

#: Two fingerprints are near within so many of 256 bits.
NEAR = 10
#: Why two photos overlap: equal as they are, equal only after normalisation, near by fingerprint.
EXACT = ("same_group", "same_number", "same_name", "near_print")
REASONS = (*EXACT, "alike_group", "alike_name")


def canonical(text: Column) -> Column:
    """Lower case, punctuation as blanks, runs of blanks as one, none around; null stays null."""
    return trimmed(F.regexp_replace(F.lower(text), r"[\p{Punct}\s]+", " "))


def split_photos(photos: DataFrame, crops: DataFrame) -> DataFrame:
    """Facts of every photo that has crops in a split, a row a row of photos: photo_id, side (train or eval), split, board, package, keys."""
    p = photos.select(
        "photo_id", plain_path("dataset_path").alias("path"), board_of("board", "dataset_path").alias("board"), "package",
        F.nullif(trimmed("group_id"), F.lit("")).alias("group_id"), component_number("component_hint", "image_name").alias("number"),
        F.nullif(F.lower("image_name"), F.lit("")).alias("name"), fingerprint_hex("fingerprint").alias("print"),
    ).where("photo_id is not null and board is not null and package is not null")
    s = crops.select(plain_path("dataset_path").alias("path"), split_name("split").alias("split")).where("split is not null").distinct()
    return p.join(s, "path").drop("path").withColumn("side", F.when(F.col("split") == "train", "train").otherwise("eval"))


def _keys(p: DataFrame) -> DataFrame:
    """A row for every key of a photo: 128-bit hash of block, kind and canonical value, with the hash of the value as it is."""

    def one(kind: str, value: Column, plain: Column) -> Column:
        key = F.struct(F.xxhash64(F.lit(kind), "board", "package", plain).alias("a"), F.xxhash64(F.lit(f"{kind} again"), "board", "package", plain).alias("b"))
        return F.when(plain.isNotNull() & (plain != ""), F.struct(key.alias("key"), F.lit(kind).alias("kind"), F.xxhash64(value).alias("raw")))

    keys = [one("group", F.col("group_id"), canonical(F.col("group_id"))), one("number", F.col("number"), F.col("number")), one("name", F.col("name"), canonical(F.col("name")))]
    # values of punctuation only are compared as they are
    keys += [one(kind, F.col(c), F.when(canonical(F.col(c)) == "", F.col(c))) for kind, c in (("group", "group_id"), ("name", "name"))]
    return p.select("side", "photo_id", "split", "board", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("side", "photo_id", "split", "board", "k.*")


def _flags(**true: Column) -> list[Column]:
    return [F.coalesce(true.get(r, F.lit(False)), F.lit(False)).alias(r) for r in REASONS]


def cross_split_pairs(photos: DataFrame, crops: DataFrame) -> DataFrame:
    """(photo_id_a, photo_id_b, eval_photo, split, board, a flag a reason) of a train and a val or test photo of one board
    and package that are the same or nearly.

    Hashes of canonical keys (group_id, component number, image name; lower case, punctuation and blanks as one blank) of
    evaluation photos are joined with those of train photos: alike_group and alike_name mark pairs that are equal only in
    that form, same_group, same_number and same_name those that are equal as they are (names whatever their case). Fingerprints
    within 10 of 256 bits are found by near_classes(), photos of equal fingerprints as one class. A key or fingerprint
    that a third of the photos share is dealt to many tasks; no pair is lost. Unreadable, zero or null keys match nothing.
    A photo that has crops on both sides counts on both, but never matches itself. Empty tables give an empty result.
    """
    p = written(split_photos(photos, crops), "split-photos")
    k = _keys(p)
    left = k.where("side = 'eval'").select("key", "kind", F.col("raw").alias("raw_e"), F.col("photo_id").alias("e"), "split", "board")
    right = k.where("side = 'train'").select("key", F.col("raw").alias("raw_t"), F.col("photo_id").alias("t"))
    as_is = F.col("raw_e") == F.col("raw_t")
    kind = lambda n: F.col("kind") == n
    flags = _flags(same_group=kind("group") & as_is, same_number=kind("number"), same_name=kind("name") & as_is, alike_group=kind("group") & ~as_is, alike_name=kind("name") & ~as_is)
    by_key = many_to_many(left, right, ["key"]).where("e <> t").select("e", "t", "split", "board", *flags)
    block = ["board", "package"]
    prints = p.where("print is not null").select("side", "photo_id", "split", "board", F.xxhash64(*block).alias("block"), print_class(block, "print").alias("id"), "print")
    side = lambda s: prints.where(f"side = '{s}'")
    classes = [written(side(s).groupBy("id", "block").agg(F.first("print").alias("print")).select("id", "block", print_words("print").alias("w")), "prints") for s in ("eval", "train")]
    near = written(near_classes(*classes, NEAR), "near-prints")
    for c in classes:
        dropped(c)
    of_eval = near.join(side("eval").select(F.col("id").alias("ida"), F.col("photo_id").alias("e"), "split", "board"), "ida")
    by_print = many_to_many(of_eval.select("idb", "e", "split", "board"), side("train").select(F.col("id").alias("idb"), F.col("photo_id").alias("t")), ["idb"])
    by_print = by_print.where("e <> t").select("e", "t", "split", "board", *_flags(near_print=F.lit(True)))
    both = by_key.unionByName(by_print).groupBy("e", "t", "split", "board").agg(*[F.max(r).alias(r) for r in REASONS])
    alike = {"alike_group": F.col("alike_group") & ~F.col("same_group"), "alike_name": F.col("alike_name") & ~F.col("same_name")}
    both = both.withColumns(alike)
    return both.select(F.least("e", "t").alias("photo_id_a"), F.greatest("e", "t").alias("photo_id_b"), F.col("e").alias("eval_photo"), "split", "board", *REASONS)


def exact_pairs(pairs: DataFrame) -> DataFrame:
    """(photo_id_a, photo_id_b) of pairs that are equal in a key as it is, or near by fingerprint."""
    return pairs.where(" or ".join(EXACT)).select("photo_id_a", "photo_id_b").distinct()


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Photos of each evaluation split and board that are also in train, and the pairs behind them by reason."""
    return pairs.groupBy("split", "board").agg(
        F.count_distinct("eval_photo").alias("photos"), F.count("*").alias("pairs"), *[F.sum(F.col(c).cast("int")).alias(f"pairs_{c}") for c in REASONS]
    )
