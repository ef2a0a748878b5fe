import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jointmill.llm import quotas

CROPS = "dataset_path string, polygon_rank_x string, board string, package string, class_name string"
TARGETS = "target_id bigint, plan_id bigint, board string, sample_size int, class_name string, package string, target_pct int, min_count int"


@pytest.mark.parametrize(
    "size,pct,least,have,want",
    [
        (10, [50, 50], [0, 0], [100, 100], [5, 5]), (10, [33, 33, 34], [0, 0, 0], [100] * 3, [3, 3, 4]), (10, [90, 10], [0, 5], [100, 100], [5, 5]),
        (10, [90, 10], [0, 0], [3, 100], [3, 7]), (10, [50, 50], [0, 0], [2, 3], [2, 3]), (4, [50, 50], [6, 0], [9, 9], [6, 0]), (0, [50, 50], [0, 0], [5, 5], [0, 0]), (7, [0, 100], [2, 0], [5, 5], [2, 5]),
    ],
)
def test_allocate(size, pct, least, have, want):
    assert quotas.allocate(size, pct, least, have) == want


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 400), st.lists(st.tuples(st.sampled_from([0, 1, 5, 10, 33, 50, 100]), st.sampled_from([0, 0, 2, 5, 20]), st.sampled_from([0, 1, 3, 10, 50, 1000])), min_size=1, max_size=7))
def test_allocation_of_any_plan(size, rows):
    """Floors and caps hold, the size is met as far as they allow, and no two free categories could be nearer to their shares."""
    pct, least, have = (list(x) for x in zip(*rows, strict=True))
    q = quotas.allocate(size, pct, least, have)
    low = [min(a, b) for a, b in zip(least, have, strict=True)]
    assert all(a <= x <= b for a, x, b in zip(low, q, have, strict=True))
    assert sum(q) == max(sum(low), min(size, sum(h if p else a for p, a, h in zip(pct, low, have, strict=True))))
    free = [i for i in range(len(q)) if pct[i] and low[i] < q[i] < have[i]]
    for i in free:
        for j in free:  # both follow one level to within the rounding of one
            assert abs(q[i] / pct[i] - q[j] / pct[j]) <= 1 / pct[i] + 1 / pct[j]


def test_hot_category_is_ranked_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(quotas, "RANKED", 40)
    t = spark.createDataFrame([(1, 1, "A", 150, "normal", None, 100, 0), (2, 2, "A", 30, "normal", "R1", 100, 0)], TARGETS)
    small = {(r["target_id"], r["crop_id"]) for r in quotas.target_sample(crops(spark), t)[0].collect()}
    monkeypatch.setattr(quotas, "RANKED", 5000)
    assert small == {(r["target_id"], r["crop_id"]) for r in quotas.target_sample(crops(spark), t)[0].collect()} and len(small) == 180


def crops(spark):
    rows = [(f"D/A/R1/V2/{i}.jpg", "1", None if i % 2 else "A", "R1", ["normal", "GOOD ", "spike"][i % 3]) for i in range(300)]
    rows += [(f"./D//A/R1/V2/{i}.jpg", " 1", "A", "R1", "Normal") for i in range(0, 30, 3)] + [("D/A/R2/V2/x.jpg", "1", "A", "R2", "excess"), ("D/A/R2/V2/y.jpg", "1", "A", "R2", None), (None, "1", "A", "R2", "excess")]
    return spark.createDataFrame(rows, CROPS)


def test_sample_and_report(spark, rows):
    t = [(1, 1, "A", 60, "normal", None, 50, 0), (2, 1, "A", 60, " SPIKE", None, 40, 5), (3, 1, "A", 60, "excess", None, 10, 3), (4, 2, "A", 1000, "normal", "R1", 90, 0), (5, 2, "A", 1000, "excess", "R9", 10, 1), (6, 3, None, 10, "normal", None, 100, 0), (7, 3, "A", 10, "what", None, None, None)]
    sample, report = quotas.target_sample(crops(spark), spark.createDataFrame(t, TARGETS))
    r = {x["target_id"]: x for x in report.collect()}
    assert [r[i]["have"] for i in range(1, 8)] == [200, 100, 1, 200, 0, 0, 0]
    assert r[1]["drawn"] + r[2]["drawn"] + r[3]["drawn"] == 60 and r[3]["drawn"] == 1
    assert [r[i]["short_by_count"] for i in range(1, 8)] == [False, False, True, False, True, False, False]
    assert [r[i]["short_by_share"] for i in range(1, 8)] == [False, False, True, True, True, True, False]
    assert sample.count() == sample.distinct().count() == sum(x["drawn"] for x in r.values())
    again, _ = quotas.target_sample(crops(spark).repartition(5), spark.createDataFrame(t, TARGETS))
    assert sample.exceptAll(again).count() == 0


def test_packages_are_disjoint(spark):
    t = [(1, 1, "A", 10, "normal", None, 50, 0), (2, 1, "A", 10, "normal", "R1", 50, 0)]
    more = crops(spark).union(spark.createDataFrame([(f"D/A/R3/V2/n{i}.jpg", "1", "A", "R3", "normal") for i in range(20)], CROPS))
    sample, _ = quotas.target_sample(more, spark.createDataFrame(t, TARGETS))
    assert sample.select("crop_id").distinct().count() == 10
    assert sample.where("target_id = 1 and not contains(crop_id, '/R3/')").count() == 0


def test_clashing_names(spark):
    t = spark.createDataFrame([(1, 1, "A", 10, "normal", None, 100, 1)], TARGETS).withColumns({c: F.lit("x") for c in ("have", "quota", "category", "taken", "drawn", "all", "key", "place", "most", "r")})
    sample, report = quotas.target_sample(crops(spark).withColumns({c: F.lit("x") for c in ("key", "packages", "r", "k", "category")}), t)
    assert sample.count() == 10 and report.first()["have"] == 200


def test_empty(spark):
    t = spark.createDataFrame([(1, 1, "A", 10, "normal", None, 100, 1)], TARGETS)
    sample, report = quotas.target_sample(crops(spark).limit(0), t)
    assert sample.count() == 0 and report.first()["short_by_count"]
    sample, report = quotas.target_sample(crops(spark), t.limit(0))
    assert sample.count() == 0 and report.count() == 0
