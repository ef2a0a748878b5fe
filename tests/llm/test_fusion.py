import random

import pytest
from pyspark.sql import functions as F

from jointmill.llm import fusion, queries

SCHEMA = (
    "record_id bigint, image_name string, dataset_path string, board string, package string, viewpoint string, light_direction string, capture_timestamp string, raw_label string, class string,"
    " points array<array<double>>, polygon_count int, polygon_rank_x int, joint_position string, merged_from string, annotator string, origin string, updated_at timestamp, loaded_at timestamp"
)


def record(i, image, x, cls=None, raw=None, merged=None, who="ann", how="manual", **more):
    r = {"record_id": i, "image_name": image, "dataset_path": f"D/A/R/V2/{image}", "board": "A", "package": "R", "viewpoint": "V2", "class": cls, "raw_label": raw, "merged_from": merged, "annotator": who, "origin": how}
    return r | {"points": None if x is None else [[x - 5.0, 0.0], [x + 5.0, 8.0]]} | more


def table(spark, records):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], SCHEMA)


def test_joints_and_fields(spark, rows):
    data = [
        record(1, "a.jpg", 100.0, "NORMAL "), record(2, "A.JPG", 299.0, "?", "exc_solder"), record(3, "a.jpg", 480.0, None, None, "spike+normal"),  # a chain: gaps of 199 and 181
        record(4, "a.jpg", 680.0, "good"), record(4, "a.jpg", 680.0, "good"), record(5, "a.jpg", 1500.0, None, None, None), record(6, "a.jpg", 1600.0, "x"),
        record(7, "b.jpg", 5.0, "spike"), record(8, "b.jpg", 6.0, "poor_solder"), record(9, "b.jpg", None, "spike"), record(10, "b.jpg", -300.0, "spike", board=None),
    ]
    s = fusion.survivors(table(spark, data))
    got = rows(s, "set_id", "several", "class", "polygon_rank_x", "polygon_count", "joint_position")
    assert sorted(got) == [
        (1, True, "spike", 1, 3, "left"), (4, False, "normal", 2, 3, "middle"), (5, True, None, 3, 3, "right"),
        (7, True, "insufficient", 2, 2, "right"), (9, False, "spike", None, None, None), (10, False, "spike", 1, 2, "left"),
    ]
    assert {r["set_id"]: r["points"] for r in s.collect()}[1] == [[95.0, 0.0], [485.0, 0.0], [485.0, 8.0], [95.0, 8.0]]
    assert all(r["class"] is None or r["class"] in r["merged_from"].split("+") for r in s.collect())


def test_empty(spark):
    assert fusion.survivors(table(spark, [])).count() == 0
    assert fusion.survivors(table(spark, [record(None, "a", 1.0), record(1, None, 1.0, who=None, how=None)])).count() == 1


def test_sources_are_learned(spark):
    """A careless source is told from careful ones, and its claims are overruled in the multi-valued field."""
    rng, data, i = random.Random(8), [], 0
    for j in range(400):
        true = rng.choice(["normal", "excess"])
        for who, right in (("good1", 0.95), ("good2", 0.95), ("bad", 0.5)):
            i += 1
            data.append(record(i, f"i{j}.jpg", 100.0, true if rng.random() < right else rng.choice(["normal", "excess", "spike", "insufficient"]), who=who))
    records = fusion.statements(table(spark, data))
    p = fusion._per_joint(records.select("pa", "pb", "x", "record_id", "place", "source", "bits"), fusion._said(), fusion._merged()).groupBy("claims").agg(F.count("*").alias("n"))
    quality, prior = fusion.source_quality(p)
    model = {r["source"]: (r["sensitivity"], r["specificity"]) for r in quality.collect()}
    assert min(model["good1/manual"]) > max(0.85, model["bad/manual"][0] + 0.1) and min(model["good2/manual"]) > 0.85
    assert abs(prior[3] - 0.5) < 0.1  # normal is half of the joints


def expected(patterns, settled, prior_counts):
    """The same model in plain Python: patterns are (claims, n)."""
    import math

    k, (good, bad) = range(4), prior_counts
    names = {s for claims, _ in patterns for s, _ in claims}
    q, prior = {s: (0.8, 0.9) for s in names}, [0.3] * 4
    while True:
        sums = {s: [0.0] * 4 for s in names}
        share, total = [0.0] * 4, sum(n for _, n in patterns)
        for claims, n in patterns:
            for v in k:
                z = math.log(prior[v] / (1 - prior[v])) + sum(math.log(q[s][0] / (1 - q[s][1])) if b >> v & 1 else math.log((1 - q[s][0]) / q[s][1]) for s, b in claims)
                p = 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
                share[v] += n * p / total
                for s, b in claims:
                    said = b >> v & 1
                    for i, x in enumerate((p * said, p, (1 - p) * (1 - said), 1 - p)):
                        sums[s][i] += n * x
        new = {s: ((a + good) / (b + good + bad), (c + good) / (d + good + bad)) for s, (a, b, c, d) in sums.items()}
        shares = [min(0.99, max(0.01, x)) for x in share]
        moved = max([abs(x - y) for s in names for x, y in zip(new[s], q[s], strict=True)] + [abs(x - y) for x, y in zip(shares, prior, strict=True)])
        q, prior = new, shares
        if moved < settled:
            return q, prior


def test_qualities_against_plain_python(spark):
    rng = random.Random(5)
    patterns = [([(s, rng.choice([1, 2, 4, 8, 3])) for s in rng.sample(["a", "b", "c", "d"], rng.randrange(1, 4))], rng.randrange(1, 9)) for _ in range(60)]
    patterns = list({tuple(sorted(c)): (sorted(c), n) for c, n in patterns}.values())
    df = spark.createDataFrame(patterns, "claims array<struct<source string, bits int>>, n bigint")
    quality, prior = fusion.source_quality(df, settled=0.01)
    want, want_prior = expected(patterns, 0.01, fusion.PRIOR)
    got = {r["source"]: (r["sensitivity"], r["specificity"]) for r in quality.collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for s in got for x, y in zip(got[s], want[s], strict=True))
    assert all(abs(x - y) < 1e-9 for x, y in zip(prior, want_prior, strict=True))
    with pytest.raises(RuntimeError, match="settle"):
        fusion.source_quality(df, settled=0.0, most=2)


def test_planted_qualities_are_recovered(spark):
    """Sources that miss and invent at known rates, on joints that show several classes: found to within 0.06."""
    rng = random.Random(12)
    planted = {"s1": (0.95, 0.98), "s2": (0.85, 0.93), "s3": (0.7, 0.85), "s4": (0.9, 0.9)}
    counts = {}
    for _ in range(4000):
        true = sum(1 << v for v, p in enumerate((0.3, 0.2, 0.4, 0.25)) if rng.random() < p)
        says = lambda s: sum(1 << v for v in range(4) if (rng.random() < planted[s][0] if true >> v & 1 else rng.random() >= planted[s][1]))  # noqa: E731, B023
        claims = tuple((s, says(s)) for s in planted)
        counts[claims] = counts.get(claims, 0) + 1
    df = spark.createDataFrame([([*c], n) for c, n in counts.items()], "claims array<struct<source string, bits int>>, n bigint")
    quality, prior = fusion.source_quality(df)
    for r in quality.collect():
        assert all(abs(x - y) < 0.06 for x, y in zip((r["sensitivity"], r["specificity"]), planted[r["source"]], strict=True)), r
    assert all(abs(x - y) < 0.06 for x, y in zip(prior, (0.3, 0.2, 0.4, 0.25), strict=True))


def test_trusted_fields(spark):
    data = [record(10 * j + k, f"p{j}.jpg", 100.0, cls, who=who) for j in range(60) for k, (who, cls) in enumerate([("good", "normal"), ("fine", "normal"), ("bad", ("spike", "excess", "insufficient")[j % 3])])]
    data += [record(1, "q.jpg", 100.0, "normal", who="bad", light_direction="bad"), record(2, "q.jpg", 100.0, "normal", who="good", light_direction="good"), record(3, "q.jpg", 100.0, "normal", who="fine", light_direction=" ")]
    out = {r["image_name"]: r for r in fusion.survivors(table(spark, data)).collect()}
    assert out["q.jpg"]["light_direction"] == "good"


def test_hot_photo_is_aggregated(spark):
    df = spark.range(20000).select(*[F.lit(None).cast(t).alias(n) if n not in ("record_id", "points", "board", "package", "viewpoint", "image_name", "class") else {"record_id": F.col("id"), "points": F.array(F.array(F.col("id") % 1000 * 2.0, F.lit(0.0)))}.get(n, F.lit("normal" if n == "class" else "k")).alias(n) for n, t in (c.split() for c in SCHEMA.split(", "))])
    r = fusion.survivors(df).collect()
    assert len(r) == 1 and (r[0]["set_id"], r[0]["class"], r[0]["polygon_rank_x"]) == (0, "normal", 1)


def test_found_joints_are_surviving_records(spark, rows, monkeypatch, tmp_path):
    """p5_found lists what survivors() makes of all records, the sources' qualities learned; it has no way of its own."""
    data = [record(10 * j + k, f"p{j}.jpg", 100.0, cls, who=who) for j in range(1, 20) for k, (who, cls) in enumerate([("good", "normal"), ("fine", "GOOD "), ("bad", ("spike", "excess", "?")[j % 3])])]
    data += [record(1, "q.jpg", 900.0, None), record(2, "q.jpg", 950.0, "x"), record(3, "q.jpg", 100.0, None, None, "spike+normal"), record(4, "q.jpg", None, "spike"), record(None, "q.jpg", 120.0, "spike"), record(3, "q.jpg", 100.0, None, None, "spike+normal")]
    table(spark, data).write.parquet(f"{tmp_path}/polygons.parquet")
    learned, calls = fusion.source_quality, []
    monkeypatch.setattr(fusion, "source_quality", lambda *a, **k: calls.append(learned(*a, **k)) or calls[-1])
    want = {(10 * j, ("spike", "excess", "normal")[j % 3], 1) for j in range(1, 20)} | {(1, None, 2)}
    assert {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()} == want
    assert len(calls) == 1 and {r["source"] for r in calls[0][0].collect()} == {"good/manual", "fine/manual", "bad/manual", "ann/manual"}
    made = fusion.survivors
    monkeypatch.setattr(fusion, "survivors", lambda p: made(p).where("set_id <> 10"))
    assert {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()} == want - {(10, "excess", 1)}


def test_found_joints_of_no_records(spark, tmp_path):
    table(spark, [record(None, "a", 1.0)]).write.parquet(f"{tmp_path}/polygons.parquet")
    found = queries.p5_found(spark, str(tmp_path))
    assert found.count() == 0 and found.columns == ["set_id", "class", "polygon_rank_x"]
