"""Annotation JSON in any of its four layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jointmill.functions.paths import file_name

_SHAPE = "struct<label string, points array<array<double>>>"
_RECORD = f"struct<imagePath string, imageWidth double, imageHeight double, shapes array<{_SHAPE}>>"
_COCO = (
    "struct<images array<struct<id bigint, file_name string, width double, height double>>,"
    " annotations array<struct<image_id bigint, category_id bigint>>, categories array<struct<id bigint, name string>>>"
)
MISSING_LABEL = "<missing label>"


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all .json files below root, one row a file, with the text of embedded images blanked."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), without_image_data("value").alias("text"))


def without_image_data(text: Column | str) -> Column:
    """JSON text whose imageData strings are emptied, so that megabytes of base64 are never parsed."""
    return F.regexp_replace(text, r'"imageData"\s*:\s*"[^"]*"', '"imageData": ""')


def layout(text: Column | str) -> Column:
    """record, list, coco, mapping, unrecognized, or unreadable for text that isn't JSON. An empty list is unrecognized."""
    v = F.try_parse_json(F.col(text) if isinstance(text, str) else text)
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "unreadable").when(kind.startswith("ARRAY<OBJECT"), "list").when(~kind.startswith("OBJECT<"), "unrecognized")
        .when(has("shapes"), "record").when(has("annotations") & has("images"), "coco").when(kind.contains("OBJECT<") & kind.rlike(r": OBJECT<"), "mapping").otherwise("unrecognized")
    )


def _shapes(shapes: Column) -> Column:
    """Shapes that are objects; without a label they get a mark, without points an empty list."""
    there = F.filter(F.coalesce(shapes, F.array().cast(f"array<{_SHAPE}>")), lambda s: s.isNotNull())
    return F.transform(there, lambda s: F.struct(F.coalesce(s["label"], F.lit(MISSING_LABEL)).alias("label"), F.coalesce(s["points"], F.array().cast("array<array<double>>")).alias("points")))


def _of_record(r: Column, fallback: Column) -> list[Column]:
    named = F.nullif(F.coalesce(r["imagePath"], F.lit("")), F.lit(""))
    return [file_name(F.coalesce(named, fallback)).alias("image_name"), r["imageWidth"].cast("int").alias("width"), r["imageHeight"].cast("int").alias("height"), _shapes(r["shapes"]).alias("shapes")]


def annotations(texts: DataFrame) -> DataFrame:
    """(source, layout, image_name, width, height, shapes, labels): one row an annotated image.

    labels counts the shapes by label; images in COCO layout have labels of their annotations and no shapes, and an
    empty map without annotations. Unreadable and unrecognized files give no rows; see unreadable().
    """
    t = texts.withColumn("layout", layout("text"))
    pick = lambda k: t.where(F.col("layout") == k)
    single = pick("record").withColumn("r", F.from_json("text", _RECORD)).select(F.col("path").alias("source"), "layout", *_of_record(F.col("r"), F.col("path")))
    many = pick("list").withColumn("r", F.explode(F.from_json("text", f"array<{_RECORD}>"))).select(F.col("path").alias("source"), "layout", *_of_record(F.col("r"), F.col("path")))
    named = pick("mapping").select("path", "layout", F.explode(F.from_json("text", f"map<string,{_RECORD}>")).alias("k", "r")).select(F.col("path").alias("source"), "layout", *_of_record(F.col("r"), F.col("k")))
    shaped = single.unionByName(many).unionByName(named)
    counted = F.aggregate(
        "shapes", F.create_map().cast("map<string,bigint>"),
        lambda m, s: F.map_concat(F.map_filter(m, lambda k, _: k != s["label"]), F.create_map(s["label"], F.coalesce(F.try_element_at(m, s["label"]), F.lit(0).cast("bigint")) + 1)),
    )
    shaped = shaped.withColumn("labels", counted)
    c = pick("coco").withColumn("c", F.from_json("text", _COCO))
    images = c.select(F.col("path").alias("source"), F.explode("c.images").alias("i"))
    cats = c.select(F.col("path").alias("source"), F.explode("c.categories").alias("k")).select("source", F.col("k.id").alias("category_id"), F.col("k.name").alias("label"))
    anns = c.select(F.col("path").alias("source"), F.explode("c.annotations").alias("a")).select("source", F.col("a.image_id").alias("image_id"), F.col("a.category_id").alias("category_id"))
    n = anns.join(cats, ["source", "category_id"], "left").groupBy("source", "image_id", F.coalesce("label", F.lit(MISSING_LABEL)).alias("label")).agg(F.count("*").alias("n"))
    n = n.groupBy("source", "image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    coco = images.select("source", F.col("i.id").alias("image_id"), "i").join(n, ["source", "image_id"], "left")
    coco = coco.select(
        "source", F.lit("coco").alias("layout"), file_name(F.col("i.file_name")).alias("image_name"), F.col("i.width").cast("int").alias("width"), F.col("i.height").cast("int").alias("height"),
        F.array().cast(f"array<{_SHAPE}>").alias("shapes"), F.coalesce("labels", F.create_map().cast("map<string,bigint>")).alias("labels"),
    )
    return shaped.unionByName(coco)


def unreadable(texts: DataFrame) -> DataFrame:
    """(path, reason) of files that hold no annotations."""
    return texts.withColumn("reason", layout("text")).where(F.col("reason").isin("unreadable", "unrecognized")).select("path", "reason")
