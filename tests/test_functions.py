import math

import pytest
from pyspark.sql import functions as F

from jointmill.functions import geometry, labels, paths, scores


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double"}
    row = spark.range(1).select(*[F.lit(v).cast(kinds.get(type(v), "string")).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "given,plain",
    [("Dataset\\CS1\\a.jpg", "Dataset/CS1/a.jpg"), ("./Dataset//CS1/a.jpg ", "Dataset/CS1/a.jpg"), (" ././a/B.JPG\t", "a/B.JPG"), ("", ""), (None, None), ("a", "a")],
)
def test_plain_path(spark, given, plain):
    assert one(spark, paths.plain_path("p"), p=given) == plain


def test_plain_crop_id(spark):
    assert one(spark, paths.plain_crop_id("c"), c=".\\Dataset\\CS1//x.jpg #2 ") == "Dataset/CS1/x.jpg#2"
    assert one(spark, paths.plain_crop_id("c"), c="a//b") == "a/b"
    assert one(spark, paths.plain_crop_id("c"), c=None) is None


@pytest.mark.parametrize("hint,name,number", [("C 019", "x.jpg", "19"), ("", "WIN_Pro_C07.JPG", "7"), ("c0", "a_C9.jpg", "0"), (None, "a_C9_x.jpg", None), (" C-11", "a_C9.jpg", "11"), (None, None, None)])
def test_component_number(spark, hint, name, number):
    assert one(spark, paths.component_number("h", "n"), h=hint, n=name) == number


def test_board_of(spark):
    assert one(spark, paths.board_of("b", "p"), b=None, p="Dataset\\CS9\\x.jpg") == "CS9"
    assert one(spark, paths.board_of("b", "p"), b="CS1", p="Dataset/CS9/x.jpg") == "CS1"
    assert one(spark, paths.board_of("b", "p"), b=None, p="x.jpg") is None


def test_names(spark):
    assert one(spark, paths.stem("p"), p="a/b.c/WIN_1.tar.gz") == "WIN_1.tar"
    assert one(spark, paths.extension("p"), p="a/B.JPG") == ".jpg"
    assert one(spark, paths.folder("p"), p="B.JPG") == "."
    assert one(spark, paths.component_hint("s"), s="WIN_Pro_C12") == "C12"
    assert one(spark, paths.component_hint("s"), s="WIN_Pro") == ""
    assert one(spark, paths.capture_timestamp("s"), s="WIN_20250101_10_20_30_Pro") == "2025-01-01T10:20:30"
    assert one(spark, paths.capture_timestamp("s"), s="WIN_20250101_10_20_30_Pro_C1") is None
    assert one(spark, paths.short_label("s", F.lit("C7")), s="WIN_20250101_10_20_30_Pro_C7") == "10_20_30 C7"


def test_path_info(spark):
    info = lambda p: one(spark, paths.path_info(F.split(F.lit(p), "/"))).asDict()
    assert info("Dataset/CS1/R0805/V1/Setup2") == {"board": "CS1", "package": "R0805", "viewpoint": "V1", "setup": "Setup2"}
    assert info("V2") == {"board": None, "package": None, "viewpoint": "V2", "setup": None}
    assert info("Labeled") == {"board": None, "package": None, "viewpoint": None, "setup": None}


@pytest.mark.parametrize("given,name", [("GOOD ", "normal"), ("Excess", "excess"), ("poor_solder", "insufficient"), (" SPIKE", "spike"), ("?", None), ("", None), (None, None)])
def test_joint_class(spark, given, name):
    assert one(spark, labels.joint_class("c"), c=given) == name


@pytest.mark.parametrize("given,name", [(" Train", "train"), ("VALIDATION", "val"), ("testing", "test"), ("holdout", None), (None, None)])
def test_split_name(spark, given, name):
    assert one(spark, labels.split_name("c"), c=given) == name


def box(x0, y0, x1, y1):
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


@pytest.mark.parametrize("b,want", [((50, 40, 150, 240), (0, 20, 240, 260)), ((0, 0, 60, 50), (0, 0, 72, 72)), ((200, 100, 300, 200), (190, 90, 310, 210))])
def test_square_crop(spark, b, want):
    assert tuple(one(spark, geometry.square_crop(box(*b), 0.1, F.lit(400), F.lit(300)))) == want


def test_boxes(spark):
    assert tuple(one(spark, geometry.clamped_box(box(25, 25, 75, 35), 0.2, F.lit(200), F.lit(200)))) == (15, 15, 85, 45)
    assert tuple(one(spark, geometry.clamped_box(box(5, 5, 55, 15), 1, F.lit(64), F.lit(64)))) == (0, 0, 64, 64)
    assert tuple(one(spark, geometry.expanded(box(50, 40, 150, 240), 0.1))) == (40, 20, 160, 260)
    assert tuple(one(spark, geometry.squared(box(50, 40, 150, 240)))) == (0, 40, 200, 240)
    shifted = tuple(one(spark, geometry.fitted(box(250, 150, 450, 350), F.lit(400), F.lit(300))))
    assert shifted[2:] == (400, 300) and shifted[2] - shifted[0] == 200


def test_polygons(spark):
    square = F.from_json(F.lit("[[0,0],[2,0],[2,2],[0,2]]"), "array<array<double>>")
    assert one(spark, geometry.polygon_area(square)) == 4
    assert one(spark, geometry.vertex_mean_x(square)) == 1
    assert tuple(one(spark, geometry.bbox(square))) == (0, 0, 2, 2)
    empty = F.from_json(F.lit("[]"), "array<array<double>>")
    assert one(spark, geometry.polygon_area(empty)) == 0
    assert one(spark, geometry.vertex_mean_x(empty)) == 0
    assert one(spark, geometry.bbox_center_x(empty)) is None


def test_scores(spark):
    zeros = F.array(*[F.lit(0.0).cast("float")] * 4)
    assert one(spark, scores.defect_score(zeros)) == 0.75
    assert one(spark, scores.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert one(spark, scores.argmax(F.array().cast("array<double>"))) is None
    h = lambda a, b: one(spark, scores.hamming_hex("a", "b"), a=a * 64, b=b * 64)
    assert (h("0", "1"), h("0", "f"), h("a", "a")) == (64, 256, 0)
    assert one(spark, scores.fingerprint_hex("f"), f=" 0x" + "AB" * 32) == "ab" * 32
    assert one(spark, scores.fingerprint_hex("f"), f="0" * 64) is None
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert math.isclose(one(spark, scores.cosine(v(1, 0), v(5, 0))), 1.0)
    assert one(spark, scores.cosine(v(0, 0), v(5, 0))) == 0
