"""Order statistics on crowded values, and the operators that were missing before."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from jointmill.operators import components, grouping, inventory, metrics, polygons, sampling, similarity, splits
from jointmill.plans import pipelines
from jointmill.sources import tables


def test_sums_over_crowded_scores(spark):
    """All scores lie within 1e-6 of 0 but two, and yet the ranges hold about equally many."""
    rng = random.Random(3)
    data = [("k", rng.random() * 1e-6, rng.randrange(1, 4)) for _ in range(6000)] + [("k", 1.0, 5), ("k", -1.0, 2), ("one", 0.5, 7), (None, 0.1, 1)]
    df = spark.createDataFrame(data, "k string, s double, n int")
    got = metrics.running_sums(df, ["k"], "s", ["n"], together=500)
    want, total = {}, {}
    for k in ("k", "one", None):
        run = 0
        for _, s, n in sorted((d for d in data if d[0] == k), key=lambda d: -d[1]):
            run += n
            want[k, s] = run
        total[k] = run
    assert {(r["k"], r["s"]): r["cum_n"] for r in got.collect()} == want
    assert {(r["k"], r["all_n"]) for r in got.collect()} == set(total.items())
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "percentile_approx" in plan
    ends = df.where("k = 'k'").agg(F.percentile_approx("s", [i / 512 for i in range(1, 512)], F.lit(10240)).alias("q")).first()["q"]
    assert sum(q < 1e-6 for q in ends) > 500


def test_exact_medians(spark):
    rng = random.Random(4)
    data = [(k, float(rng.randrange(50)), rng.random() if rng.random() < 0.9 else None) for k in ("a", "b") for _ in range(rng.randrange(90, 130))] + [("c", None, float("nan"))]
    got = {r["k"]: (r["median_x"], r["median_y"]) for r in metrics.medians(spark.createDataFrame(data, "k string, x double, y double"), ["k"], ["x", "y"]).collect()}
    for k in ("a", "b"):
        own = [[d[i] for d in data if d[0] == k and d[i] is not None] for i in (1, 2)]
        assert got[k] == tuple(statistics.median(v) for v in own)
    assert "c" not in got


def test_group_numbers_of_paths_with_a_common_start(spark, rows):
    paths = [f"Dataset/a/very/long/common/start/of/all/{i:04d}.jpg" for i in range(300)]
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("root", F.col("path")).repartition(7)
    got = dict(rows(grouping.group_ids(df, "root", "path", "m"), "path", "group_id"))
    assert got == {p: f"m_{i + 1:03d}" for i, p in enumerate(paths)}


def test_numbered(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("g"), F.col("id").alias("k"))
    got = sampling.numbered(df, "g", "k", 1, together=100)
    assert {r["g"]: (r["n"], r["d"], r["lo"], r["hi"]) for r in got.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("place").alias("d"), F.min("place").alias("lo"), F.max("place").alias("hi")).collect()} == {"hot": (2500, 2500, 0, 2499), "cold": (500, 500, 0, 499)}
    assert got.exceptAll(sampling.numbered(df.repartition(5), "g", "k", 1)).count() == 0


def test_weighted_sample_of_odd_rows(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", "z")], "k string, c string")
    w = spark.createDataFrame([("x", 1.0), ("y", 0.0), ("z", None)], "c string, weight double")
    assert {(r["k"], r["c"]) for r in sampling.weighted_sample(df, "k", "c", w, 20, 1).collect()} == {("a", "x")}
    assert sampling.weighted_sample(df.limit(0), "k", "c", w, 20, 1).count() == 0
    plan = sampling.weighted_sample(df, "k", "c", w, 20, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Join Cross" not in plan


def test_gates(spark, rows):
    data = [("g1", "normal", "val")] * 12 + [("g2", "spike", "val")] * 7 + [("g3", "excess", s) for s in ("val", "test") for _ in range(9)]
    got = splits.gate(spark.createDataFrame(data, "g string, class string, split string"), "split", "g", "class")
    assert ("G1", None, None, 1, 0) in [tuple(r) for r in got.collect()]
    assert {(r["gate"], r["split"], r["class"]) for r in got.collect()} >= {("G3", "val", "spike"), ("G2", "test", "normal")}
    assert not [r for r in got.collect() if r["split"] == "val" and r["class"] == "normal"]


def test_guards_of_counts_and_evaluations(spark):
    m = spark.createDataFrame([("a", "normal", "train"), ("b", "odd", "val")], "crop_id string, label string, split string")
    assert {r["label"]: r["n"] for r in splits.class_counts_of(m, "train").collect()} == {"normal": 1, "excess": 0, "insufficient": 0, "spike": 0}
    with pytest.raises(Exception, match="not allowed: odd"):
        splits.class_counts_of(m, "val").collect()
    with pytest.raises(ValueError, match="split test"):
        splits.class_counts_of(m, "test")
    for label, said in ((0, "normal"), (2, "a defect")):
        p = spark.createDataFrame([("a", label, [1.0, 0.0, 0.0, 0.0])], "crop_id string, label int, logits array<float>")
        with pytest.raises(ValueError, match=said):
            pipelines.evaluate(p)


def test_crop_run_refuses_joints_without_a_split(spark):
    j = spark.createDataFrame([(f"D/CS1/R0805/V2/p{i}.jpg", "1", "CS1", "R0805", "V2", "bottom_to_top", "good", "normal", [[10.0, 10.0], [30.0, 12.0], [20.0, 40.0]], 1, "left", "spike+normal" if i else "") for i in range(3)], "dataset_path string, polygon_rank_x string, board string, package string, viewpoint string, light_direction string, raw_label string, class string, points array<array<double>>, polygon_count int, joint_position string, merged_from string")
    s = spark.createDataFrame([(f"D/CS1/R0805/V2/p{i}.jpg#1", "g", "train") for i in range(3)], "crop_id string, group_id string, split string")
    m, said = pipelines.crop_run(j, s)
    assert m.count() == 3 and said.first()[["crops", "merged", "train", "normal"][0]] == 3 and said.first()["merged"] == 2 and said.first()["train"] == 3
    assert polygons.manifest(j, s.limit(0), 0.1, 2560, 1440).count() == 0
    with pytest.raises(Exception, match="no split of joint"):
        pipelines.crop_run(j, s.where("crop_id not like '%p1%'"))[0].collect()
    with pytest.raises(ValueError):
        pipelines.crop_run(j, s, margin=-0.1)


def test_paths_people_write(spark):
    files = spark.createDataFrame([("D/A/a.jpg",), ("D/B/a.jpg",), ("D/B/b.jpg",)], "path string")
    assert inventory.find_path(files, "D\\A\\a.jpg") == "D/A/a.jpg" and inventory.find_path(files, "b.jpg") == "D/B/b.jpg"
    for bad, said in (("a.jpg", "more than one"), ("c.jpg", "no photo"), ("", "no photo")):
        with pytest.raises(ValueError, match=said):
            inventory.find_path(files, bad)


def test_spanning_groups(spark, rows):
    df = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a"), ("h", "a"), (None, "a")], "g string, c string")
    assert rows(grouping.spanning(df, "g", "c")) == [("g", 2)]


def test_files_of_hand_made_groups(spark, tmp_path, rows):
    g = spark.createDataFrame([("b", ["c", "b"]), ("a", ["a", "z"])], "root string, members array<string>")
    assert tables.save_groups(g, str(tmp_path / "x" / "pairs.json")) == [["a", "z"], ["b", "c"]]
    said = json.loads((tmp_path / "x" / "pairs.json").read_text())
    assert said["version"] == 1 and said["groups"] == [["a", "z"], ["b", "c"]]
    assert rows(tables.read_pairs(spark, str(tmp_path / "x" / "pairs.json")), "members") == [(["a", "z"],), (["b", "c"],)]
    assert tables.read_pairs(spark, str(tmp_path / "nothing.json")).count() == 0
    with pytest.raises(ValueError):
        tables.save_groups(g, str(tmp_path / "p.json"), most=1)
    m = components.connected_components(grouping.set_edges(g, "members"))
    tables.write_pairs(m, str(tmp_path / "lines"))
    assert rows(tables.read_pairs(spark, str(tmp_path / "lines"), lines=True), "members") == [(["a", "z"],), (["b", "c"],)]


def test_readers_refuse_what_is_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_manifest(spark, str(tmp_path / "none"))
    (tmp_path / "m.csv").write_text("crop_id,label,split\na,normal,train\nb,odd,val\n")
    assert [r["path"] for r in tables.read_crop_set(spark, str(tmp_path / "m.csv"), "train", "c/").collect()] == ["c/a.png"]
    with pytest.raises(Exception, match="odd"):
        tables.read_crop_set(spark, str(tmp_path / "m.csv"), "val").collect()
    for split in ("test", "holdout"):
        with pytest.raises(ValueError):
            tables.read_crop_set(spark, str(tmp_path / "m.csv"), split)
    (tmp_path / "s.csv").write_text("crop_id,split\na,train\n")
    with pytest.raises(ValueError, match="lacks"):
        tables.read_splits(spark, str(tmp_path / "s.csv"))


def test_injected_function_is_asked_in_batches(spark):
    def feature(p):
        assert len(p) <= 4
        return [None if x is None else [float(x), float(len(p))] for x in p["v"]]

    df = spark.range(10).select("id", F.when(F.col("id") != 3, F.col("id") * 2).cast("double").alias("v")).coalesce(1)
    got = {r["id"]: r["vector"] for r in similarity.embedded(df, ["id"], ["v"], feature, batch=4).collect()}
    assert len(got) == 10 and got[9][0] == 18.0 and max(v[1] for v in got.values() if v) == 4.0
