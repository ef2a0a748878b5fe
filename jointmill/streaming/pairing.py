"""Hand-made pairs as a stream: sessions arrive as files, components follow.

The reference keeps the groups of one tagging session in memory and writes them after every change. Here sessions are an
append-only log; each micro-batch joins its edges to the roots stored so far and maps the roots that change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jointmill.functions.paths import plain_path
from jointmill.operators.components import connected_components
from jointmill.session import scope
from jointmill.sources.tables import exists

SESSIONS = "tag_id bigint, cell string, version int, note string, member_groups array<array<string>>, saved_at timestamp_ntz"


def edges_of(sessions: DataFrame) -> DataFrame:
    """(a, b, tag_id) of every set of two or more photos: its smallest path with each of the others."""
    s = sessions.select("tag_id", F.explode("member_groups").alias("m"))
    s = s.select("tag_id", F.array_sort(F.array_distinct(F.filter(F.transform("m", plain_path), lambda x: x.isNotNull()))).alias("m")).where(F.size("m") > 1)
    return s.select(F.get("m", F.lit(0)).alias("a"), F.explode("m").alias("b"), "tag_id").where("a <> b")


def follow(spark: SparkSession, inbox: str, log: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follow the session files of `inbox`; keep edges in `log` and the components in `out`, both Parquet.

    A batch's edges go to a folder of the batch's number, which a repeated batch overwrites, so each counts once. Only the
    batch's edges are looked at: their ends are replaced by the roots stored so far, components are found among these
    roots, and the stored roots are then mapped in one pass. The new table is written beside the old one and takes its
    place by renaming, so a reader never sees half of it; a batch that is repeated after that changes nothing.
    """
    jvm = spark._jvm.org.apache.hadoop.fs

    def swap(new: str) -> None:
        fs = jvm.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
        old = jvm.Path(f"{out}-old")
        fs.delete(old, True)
        if fs.exists(jvm.Path(out)):
            fs.rename(jvm.Path(out), old)
        fs.rename(jvm.Path(new), jvm.Path(out))
        fs.delete(old, True)

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        with scope(own):
            edges_of(batch).write.mode("overwrite").parquet(f"{log}/batch={number}")
            edges = own.read.parquet(f"{log}/batch={number}").select("a", "b")
            if not exists(own, out) and exists(own, f"{out}-old"):  # a swap that was cut short
                jvm.Path(out).getFileSystem(own._jsc.hadoopConfiguration()).rename(jvm.Path(f"{out}-old"), jvm.Path(out))
            stored = own.read.parquet(out) if exists(own, out) else own.createDataFrame([], "node string, root string")
            root = lambda end: F.coalesce(F.col(f"{end}_root"), F.col(end)).alias(end)
            of = lambda end: stored.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
            among = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(root("a"), root("b"))
            moved = connected_components(among).select(F.col("node").alias("root"), F.col("root").alias("new"))
            kept = stored.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            fresh = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(stored.select("node"), "node", "left_anti")
            fresh = fresh.join(moved.select(F.col("root").alias("node"), "new"), "node", "left").select("node", F.coalesce("new", "node").alias("root"))
            kept.unionByName(fresh).write.mode("overwrite").parquet(f"{out}-next")
        swap(f"{out}-next")

    stream = spark.readStream.schema(SESSIONS).parquet(inbox)
    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def scored_windows(predictions: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, run_id, n, errors) of a stream of predictions by the time they were scored; later rows than `late` are left out.

    A convenience beyond the reference, which has no streams.
    """
    p = predictions.withColumn("at", F.col("scored_at").cast("timestamp")).withWatermark("at", late)
    return p.groupBy(F.window("at", length), "run_id").agg(F.count("*").alias("n"), F.sum((F.col("label") != F.col("pred")).cast("long")).alias("errors"))
