"""Queries and operators that once did less than the whole job."""

import json
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from jointmill.operators import grouping, joins, similarity
from jointmill.plans import core_queries, gated_queries, pipelines
from verify import compare, duck

DATA = os.environ.get("JOINTMILL_TESTDATA", "/root/testdata")
SWEEP = [0, 20, 40, 60, 80, 85, 90, 95, 100, 105, 110, 120, 140, 160]


def test_forest_gives_all_components(spark, rows):
    rng = random.Random(3)
    base = [rng.getrandbits(256) for _ in range(8)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(256), rng.choice([3, 30, 70, 90, 100]))) for b in base for _ in range(4)] + base[:2]
    data = [(i, "cd"[i % 2], f"{p:064x}") for i, p in enumerate(prints)] + [(1, "d", f"{prints[0]:064x}"), (90, "c", None), (91, None, f"{base[0]:064x}")]
    df = spark.createDataFrame(data, "id int, cell string, print string")
    forest = similarity.hamming_forest(df, ["cell"], "id", "print", 160, tile=6)
    pairs = similarity.hamming_pairs(df, ["cell"], "id", "print", 160)
    assert forest.count() < pairs.count()
    of = lambda p: rows(grouping.threshold_sweep(df, "id", p, "distance", SWEEP, below=True), "threshold", "id", "root")
    got = of(forest)
    assert got == of(pairs) and len({r[2] for r in got if r[0] == 160}) < len({r[2] for r in got if r[0] == 20})


def test_sweep_has_the_reference_thresholds(spark, rows):
    assert core_queries.PHASH_SWEEP == SWEEP and "grouping_sweep_whole" in core_queries.oracle_sql()
    got = rows(core_queries.queries()["grouping_sweep_whole"](spark, f"{DATA}/sf0.001").select("threshold"))
    assert sorted(t for (t,) in got) == SWEEP


def test_split_search_takes_all_candidates(spark, rows):
    d = f"{DATA}/sf0.01"
    got = rows(core_queries.queries()["split_candidates_whole"](spark, d), "candidate", "fails_normal", "fails_defect", "class_deviation", "size_deviation")
    assert sorted(r[0] for r in got) == list(range(200))
    best = min((r for r in got if not r[1] and not r[2]), key=lambda r: (r[3], r[4], r[0]))
    assert best[0] >= 20  # the best of twenty is another
    name = "split_chosen_whole"
    said = compare(spark, duck(d), name, gated_queries.queries()[name], gated_queries.oracle_sql()[name], d)
    assert said.startswith("ok"), said


def test_group_takes_the_reference_thresholds(spark):
    names = ["a", "b", "c"]
    j = spark.createDataFrame([(n, n, "CS1", "R0805", "V2") for n in names], "image_name string, dataset_path string, board string, package string, viewpoint string")
    base = 1 << 200
    prints = [base, base ^ ((1 << 10) - 1), base ^ ((1 << 60) - 1)]  # 10 and 50 bits from the next
    f = spark.createDataFrame([(n, f"{p:064x}", v) for n, p, v in zip(names, prints, ([1.0, 0.0], [0.985, 0.1726], [0.9, 0.4359]), strict=True)], "dataset_path string, fingerprint string, vector array<double>")
    groups = lambda *a: sorted(r["group_size"] for r in pipelines.group(j, *a, fingerprints=f).collect())
    assert groups("phash", None) == groups("embed", None) == [1, 2, 2]
    assert groups("phash", 100) == groups("embed", 0.88) == [3, 3, 3]


def test_guesses_leave_tagged_photos_out(spark, rows):
    d = f"{DATA}/sf0.01"
    q, ends = core_queries.queries(), ("left_item", "right_item")
    every, left = (rows(q[n](spark, d), *ends) for n in ("guessed_pairs", "guessed_pairs_untagged"))
    con = duck(d)
    plain = core_queries._TAGGED
    tagged = {r[0] for r in con.sql(f"with {core_queries.PHOTOS}, {plain} select photo_id from tagged").fetchall()}
    assert tagged and any(tagged & set(r) for r in every)
    assert left == [r for r in every if not tagged & set(r)]


def test_predictions_of_another_crop_set(spark, rows):
    crops = spark.createDataFrame([("a", "normal", "CS1"), ("b", "spike", "CS2"), ("c", None, "CS2")], "crop_id string, class string, board string")
    history = spark.createDataFrame([("b", "spike+excess")], "crop_id string, merged_from string")
    p = lambda *r: spark.createDataFrame([(c, n, [1.0, 0.0, 0.0, 0.0]) for c, n in r], "crop_id string, label int, logits array<float>")
    good = p(("a", 0), ("b", 3))
    assert rows(joins.with_crops(good, crops, history), "crop_id", "board", "merged_from") == [("a", "CS1", ""), ("b", "CS2", "spike+excess")]
    assert pipelines.evaluate(good, crops=crops, history=history)["confusion"].count() > 0 and joins.off_manifest(good, crops).count() == 0
    for bad, said in ((("b", 1), "label disagrees with crop: b 1 spike"), (("c", 0), "label disagrees"), (("b", None), "label disagrees"), (("z", 0), "no crop: z")):
        with pytest.raises(Exception, match=said):
            pipelines.evaluate(p(("a", 0), bad), crops=crops, history=history)["confusion"].collect()
    odd = joins.off_manifest(p(("a", 0), ("b", 1), ("c", 0), ("b", None), ("z", 0), (None, 0)), crops)
    assert sorted(r[0] for r in rows(odd, "reason")) == ["no crop"] * 2 + ["other label"] * 3


def png(gray):
    part = lambda k, v: struct.pack(">I", len(v)) + k + v + struct.pack(">I", zlib.crc32(k + v))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(b"\0" + bytes([gray] * 2) for _ in range(2)))) + part(b"IEND", b"")


def test_audit_has_all_tables(spark, tmp_path, rows):
    def put(path, data):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())

    for i, (place, gray) in enumerate([("V1/Setup1", 10), ("V1/Setup1", 30), ("V1/Setup2", 200), ("V1", 90)]):
        put(f"D/CS1/R0805/{place}/p{i}.png", png(gray))
    put("D/CS1/R0805/V1/Setup2/broken.png", b"no picture")
    put("Labeled/p0.png", png(10))  # a copy: counted once
    for place in ("D/CS1/R0805/V2", "D/CS1/R0805/V2.1", "D/CS2/R0805/V2"):
        put(f"{place}/same.png", png(5 if "CS2" in place else 4))
    put("D/CS1/R0805/V2/j.png", png(50))
    for name in ("j", "same", "gone"):
        put(f"Labeled/{name}.json", {"imagePath": f"{name}.png", "shapes": [{"label": "good", "points": [[1, 2]]}]})
    a = pipelines.audit(spark, str(tmp_path))
    assert rows(a["brightness"], "board", "setup", "images", "mean_brightness") == [("CS1", "<no setup folder>", 1, 90.0), ("CS1", "Setup1", 2, 20.0), ("CS1", "Setup2", 1, 200.0)]
    assert rows(a["ambiguous"]) == [("same.png",)]
    assert rows(a["missing"]) == [("gone.png",)]
    assert sum(n for _, n in rows(a["locations"], "folder", "n")) == 2 and sum(r[2] for r in rows(a["coverage"], "board", "package", "total")) == 2
    assert rows(a["duplicates"], "name", "identical") == [("p0.png", True), ("same.png", False)]
