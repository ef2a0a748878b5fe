import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jointmill.plans import pipelines
from jointmill.sources import annotations as ann
from jointmill.sources import images, tables
from jointmill.streaming import pairing


def shape(label, *xs):
    return {"label": label, "points": [[x, 0] for x in xs] + [[xs[0], 10]], "shape_type": "polygon"}


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_layouts(spark, tmp_path, rows):
    record = {"imagePath": "..\\x\\a.jpg", "imageWidth": 10, "imageHeight": 5, "imageData": "QUJD" * 50, "shapes": [shape("good", 1, 2), {"points": None}, None, shape("good", 5)]}
    write(tmp_path / "one.json", record)
    write(tmp_path / "deep/list.json", [{"imagePath": "b.jpg", "shapes": []}, {"shapes": [shape("spike", 1)]}])
    write(tmp_path / "map.json", {"c.jpg": {"shapes": [shape("spike", 1)]}})
    coco = {"images": [{"id": 1, "file_name": "p/d.jpg", "width": 4, "height": 3}, {"id": 2, "file_name": "e.jpg"}], "annotations": [{"image_id": 1, "category_id": 7}, {"image_id": 1, "category_id": 7}], "categories": [{"id": 7, "name": "good"}]}
    write(tmp_path / "coco.json", coco)
    write(tmp_path / "bad.json", "{nope")
    write(tmp_path / "empty.json", [])
    write(tmp_path / "number.json", "3")
    t = ann.read_texts(spark, str(tmp_path))
    a = {r["image_name"]: r for r in ann.annotations(t).collect()}
    assert set(a) == {"a.jpg", "b.jpg", "list.json", "c.jpg", "d.jpg", "e.jpg"}
    assert a["a.jpg"]["labels"] == {"good": 2, ann.MISSING_LABEL: 1} and (a["a.jpg"]["width"], a["a.jpg"]["height"]) == (10, 5)
    assert a["d.jpg"]["labels"] == {"good": 2} and a["d.jpg"]["shapes"] == [] and a["e.jpg"]["labels"] == {}
    assert a["c.jpg"]["layout"] == "mapping" and a["b.jpg"]["layout"] == "list"
    bad = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in ann.unreadable(t).collect()}
    assert bad == {"bad.json": "unreadable", "empty.json": "unrecognized", "number.json": "unrecognized"}
    assert t.where(F.contains("text", F.lit("QUJD"))).count() == 0


def png(pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    noise = (np.add.outer(np.arange(64), np.arange(96))[:, :, None] + rng.integers(0, 60, (64, 96, 3))).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(noise))
    (tmp_path / "b.png").write_bytes(png(np.clip(noise.astype(int) + 2, 0, 255).astype(np.uint8)))
    (tmp_path / "c.png").write_bytes(png(rng.integers(0, 255, (64, 96, 3)).astype(np.uint8)))
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.pixel_facts(spark, str(tmp_path)).collect()}
    want = (noise[:, :, 0] * 0.299 + noise[:, :, 1] * 0.587 + noise[:, :, 2] * 0.114).mean()
    assert abs(got["a.png"]["brightness"] - want) < 1e-6 and got["broken.png"]["reason"] == "not decoded"
    apart = lambda x, y: bin(int(got[x]["fingerprint"], 16) ^ int(got[y]["fingerprint"], 16)).count("1")
    assert len(got["a.png"]["fingerprint"]) == 64 and apart("a.png", "b.png") <= 10 < apart("a.png", "c.png")


def exif(how, order="<"):
    """The start of a JPEG that says how it is to be turned."""
    mark = {"<": b"II", ">": b"MM"}[order]
    tiff = mark + struct.pack(order + "HIH", 42, 8, 2) + struct.pack(order + "HHIHH", 0x0100, 3, 1, 7, 0) + struct.pack(order + "HHIHH", 0x0112, 3, 1, how, 0) + struct.pack(order + "I", 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_orientation(spark, tmp_path):
    assert [images.orientation(exif(h, o)) for h in (1, 3, 6, 8) for o in "<>"] == [1, 1, 3, 3, 6, 6, 8, 8]
    for bad in (b"", b"\x89PNG", exif(9), exif(6)[:-24], b"\xff\xd8\xff\xe1\x00\x10Exif\0\0II"):
        assert images.orientation(bad) == 1
    a = np.arange(6).reshape(2, 3)
    want = {1: a, 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    for how, seen in want.items():
        assert images.turned(a, how).tolist() == np.asarray(seen).tolist()
    (tmp_path / "a.JPG").write_bytes(exif(6))
    (tmp_path / "b.jpg").write_bytes(exif(1))
    assert [r["orientation"] for r in images.orientations(spark, str(tmp_path)).collect()] == [6]


def test_crops_as_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    photo = rng.integers(0, 255, (40, 60, 3)).astype(np.uint8)
    (tmp_path / "in" / "D").mkdir(parents=True)
    (tmp_path / "in" / "D" / "a.png").write_bytes(png(photo))
    boxes = [("c1", "c1.png", "D/a.png", 5, 6, 25, 36), ("c2", "c2.png", "D/a.png", 50, 30, 80, 60), ("c3", "c3.png", "D/a.png", 70, 0, 80, 9), ("c4", "c4.png", "D/none.png", 0, 0, 5, 5)]
    m = spark.createDataFrame(boxes, "crop_id string, image_file string, source_path string, crop_x0 int, crop_y0 int, crop_x1 int, crop_y1 int")
    cut = images.cut_crops(spark, str(tmp_path / "in"), m)
    assert {r["crop_id"]: r["reason"] for r in cut.collect()} == {"c1": None, "c2": None, "c3": "outside the photo", "c4": "no photo"}
    images.save_files(cut, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["c1.png", "c2.png"]
    back = {r["path"].rsplit("/", 1)[1]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)[:, :, ::-1] for r in images.rasters(spark, str(tmp_path / "out")).collect()}
    assert (back["c1.png"] == photo[6:36, 5:25]).all() and (back["c2.png"] == photo[30:40, 50:60]).all()
    assert bytes(cut.where("crop_id = 'c1'").first()["content"]) == (tmp_path / "out" / "c1.png").read_bytes()


def test_tables(spark, tmp_path, rows):
    df = spark.createDataFrame([("a.jpg", "D/a.jpg", [[1.0, 2.0]], None)], "image_name string, dataset_path string, points array<array<double>>, class string")
    tables.write_csv(df, str(tmp_path / "p"))
    with pytest.raises(ValueError, match="lacks the columns"):
        tables.read_polygons(spark, str(tmp_path / "p"))
    wide = df.select(*[F.col(c) if c in df.columns else F.lit("1" if "polygon_" in c else None).cast("string").alias(c) for c in (f.split()[0] for f in tables.POLYGONS.split(", "))])
    tables.write_csv(wide, str(tmp_path / "w"))
    back = tables.read_polygons(spark, str(tmp_path / "w")).first()
    assert back["points"] == [[1.0, 2.0]] and back["class"] is None and back["merged_from"] == "" and back["polygon_count"] == 1
    write(tmp_path / "pairs.json", {"version": 1, "note": "n", "groups": [["b", "a"], ["c", "d"]]})
    assert rows(tables.read_pairs(spark, str(tmp_path / "pairs.json")), "members") == [(["b", "a"],), (["c", "d"],)]
    assert tables.read_pairs(spark, str(tmp_path / "none.json")).count() == 0
    np.savez(tmp_path / "v.npz", crop_ids=np.array(["x"]), labels=np.array([2]), logits=np.zeros((1, 4), np.float32), mean_loss=0.5)
    p, loss = tables.read_predictions(spark, str(tmp_path / "v.npz"))
    assert loss == 0.5 and p.first()["label"] == 2
    write(tmp_path / "r.md", "head\n")
    assert not tables.replace_section(str(tmp_path / "r.md"), "one", "<!-- a -->", "<!-- b -->")
    assert tables.replace_section(str(tmp_path / "r.md"), "two", "<!-- a -->", "<!-- b -->")
    assert (tmp_path / "r.md").read_text() == "head\n\n<!-- a -->\ntwo\n<!-- b -->\n"
    tables.write_meta({"split_hash": "h"}, str(tmp_path / "m.json"))
    assert tables.read_meta(str(tmp_path / "m.json"), "split_hash") == "h" and tables.read_meta(str(tmp_path / "no.json"), "x") is None


def test_ingest_to_eval(spark, tmp_path, rows):
    for board in ("CS1", "CS2"):
        for i in range(12):
            name = f"WIN_20250101_10_00_{i:02d}_Pro"
            (tmp_path / f"Dataset/{board}/R0805/V2").mkdir(parents=True, exist_ok=True)
            for place in (f"Dataset/{board}/R0805/V2", "Labeled"):
                write(tmp_path / f"{place}/{board}_{name}.jpg", "x")
            write(tmp_path / f"Labeled/{board}_{name}.json", {"imagePath": f"{board}_{name}.jpg", "shapes": [shape("exc_solder", 20, 30), shape("spike", 35, 45), shape("good", 310, 320)]})
    j = pipelines.ingest(spark, str(tmp_path))
    assert j.count() == 48
    assert rows(j.where("polygon_rank_x = 1").select("class", "merged_from", "joint_position", "viewpoint").distinct()) == [("spike", "spike+excess", "left", "V2")]
    assert {r["dataset_path"].split("/")[0] for r in j.select("dataset_path").collect()} == {"Dataset"}
    g = pipelines.group(j, "coarse")
    assert g.select("group_id").distinct().count() == 2 and g.count() == 24
    a = pipelines.audit(spark, str(tmp_path))
    assert a["mirrored"].first()["names"] == 12 and a["unreadable"].count() == 0 and a["labels"].where("label = 'good'").first()["n"] == 24
    logits = spark.createDataFrame([(f"c{i}", i % 4, [float(i % 4 == k) for k in range(4)]) for i in range(40)], "crop_id string, label int, logits array<float>")
    e = pipelines.evaluate(logits)
    assert e["auroc"].first()["auroc"] == 1.0 and e["mistakes"].count() == 0 and e["confusion"].where("truth = pred and n = 10").count() == 4


def test_unmapped_label_raises(spark, tmp_path):
    write(tmp_path / "Dataset/CS1/R0805/V2/a.jpg", "x")
    write(tmp_path / "Dataset/CS1/R0805/V2/a.json", {"imagePath": "a.jpg", "shapes": [shape("odd", 1, 2)]})
    with pytest.raises(Exception, match="label without a class: odd"):
        pipelines.ingest(spark, str(tmp_path)).collect()


def test_split_pipeline(spark):
    classes = ("normal", "excess", "insufficient", "spike")
    j = spark.createDataFrame([(f"D/{g}.jpg", r, classes[g % 4]) for g in range(200) for r in (1, 2)], "dataset_path string, polygon_rank_x int, class string")
    g = j.select("dataset_path").distinct().withColumn("group_id", F.col("dataset_path"))
    out, meta = pipelines.split(j, g, candidates=40)
    assert meta["accepted"] >= 1 and len(meta["split_hash"]) == 64 and out.count() == 400
    with pytest.raises(ValueError, match="crop id occurs"):
        pipelines.split(j.union(j), g, candidates=2)
    with pytest.raises(Exception, match="no group for photo"):
        pipelines.split(j, g.limit(5), candidates=2)


def test_pairing_stream(spark, tmp_path, rows):
    def arrive(n, sets):
        df = spark.createDataFrame([(n, "c", 1, None, sets)], "tag_id bigint, cell string, version int, note string, member_groups array<array<string>>")
        df.withColumn("saved_at", F.current_timestamp().cast("timestamp_ntz")).write.mode("append").parquet(str(tmp_path / "in"))

    go = lambda: pairing.follow(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    arrive(1, [["a", "./b"], ["x", "y"]])
    go()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "node", "root") == [("a", "a"), ("b", "a"), ("x", "x"), ("y", "x")]
    arrive(2, [["b", "x"], ["q"]])
    go()
    assert {r["root"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a"}


def test_windows_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, 1, "2025-01-01 10:01:00"), ("r", 1, 0, "2025-01-01 10:02:00"), ("r", 0, 0, "2025-01-01 10:15:00")], "run_id string, label int, pred int, t string")
    df.select("run_id", "label", "pred", F.to_timestamp_ntz("t").alias("scored_at")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("run_id string, label int, pred int, scored_at timestamp_ntz").parquet(str(tmp_path / "in"))
    q = pairing.scored_windows(s).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n"], r["errors"]) for r in spark.sql("select * from w order by window.start").collect()] == [(2, 1), (1, 0)]
