from pyspark.sql import functions as F

from jointmill.plans import pipelines, reports


def test_evaluation(spark):
    data = [(f"c{i}", i % 4, [float((i + (i == 5)) % 4 == k) for k in range(4)]) for i in range(40)]
    found = pipelines.evaluate(spark.createDataFrame(data, "crop_id string, label int, logits array<float>"))
    text = reports.evaluation_report("run", found)
    assert "| excess | 10 | 0.900 | 1.000 |" in text and "| excess | 0 | 9 | 1 | 0 |" in text and "## Operating points" in text
    points = reports.roc_points(found["sweep"])
    assert points.count() == found["sweep"].count() + 1 and points.agg(F.min("hit")).first()[0] == 0.0


def test_summary(spark):
    runs = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.7), ("a", 2, float("nan")), ("b", 0, None)], "option string, seed int, auroc double")
    text = reports.summary_report(runs, ["auroc"])
    assert "| a | 3 (0, 1, 2) | 0.600 ± 0.141 (1 n/a) |" in text and "| b | 1 (0) | n/a |" in text


def test_verdict(spark):
    swept = spark.createDataFrame([(1.0, 2, 4, 9), (2.0, 4, 4, 60), (3.0, 4, 4, 4)], "threshold double, merged int, references int, largest int")
    assert reports.verdict(swept) == "usable at threshold 3: 4 of 4 reference pairs, largest group 4"
    assert reports.verdict(swept.where("threshold < 3")).startswith("no setting separates") and reports.verdict(swept.limit(0)) == "nothing was swept"
    assert "## Thresholds" in reports.grouping_report("phash", swept)


def test_sheets(spark, rows):
    got = rows(reports.sheets(spark.range(50), ["id"]), "id", "sheet", "tile")
    assert (24, 2, 1) in got and (49, 3, 2) in got and (0, 1, 1) in got
    assert rows(reports.share_table(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string"), "c"), "c", "share")[0] == ("a", 0.5)


def test_verdict_over_tolerances(spark):
    rows = [(0.0, 10.0, 4, 4, 9), (0.0, 20.0, 4, 4, 30), (0.1, 10.0, 3, 4, 3), (None, 5.0, 4, 4, 50)]
    df = spark.createDataFrame(rows, "tolerance double, threshold double, merged int, references int, largest int")
    assert reports.verdict(df) == "usable at tolerance 0.1, threshold 10: 3 of 4 reference pairs, largest group 3"
    assert reports.verdict(df.where("tolerance = 0")).startswith("no setting separates components; the best is tolerance 0, threshold 10")
    assert reports.verdict(df.limit(0)) == "nothing was swept"


def test_crop_set_text(spark):
    m = spark.createDataFrame([("normal", "val"), ("spike", "train"), ("spike", "train")], "label string, split string")
    assert reports.crop_set_text(m, "ab12").splitlines() == ["3 crops, one file a joint.", "", "Classes: spike 2, normal 1", "Splits: train 2, val 1", "Split hash: ab12"]
