import itertools
import random

from pyspark.sql import functions as F

from jointmill.llm import entity_splits, overlap

PHOTO = "photo_id bigint, image_name string, dataset_path string, board string, package string, viewpoint string, component_hint string, fingerprint string, group_id string"


def photos(spark, rng, n=120, hot=False):
    out = []
    for i in range(n):
        board, package = rng.choice(["A", "B"]), rng.choice(["R1", None]) if rng.random() < 0.05 else "R1"
        name = f"IMG_{rng.randrange(n)}{rng.choice(['', '_C3', '_C03', '_C9'])}.{rng.choice(['jpg', 'JPG'])}"
        out.append((i, name, f"D/{board}/R1/V2/{i}_{name}", rng.choice([board, None]), package, "V2", rng.choice(["", None, "C 5", "c05"]) if rng.random() < 0.1 else None, f"{rng.getrandbits(256):064x}", "hot" if hot and i % 3 == 0 else rng.choice([None, "", f"g{rng.randrange(60)}"])))
    return out


def number(hint, name):
    import re

    m = re.search(r"\d+", hint or "") or re.search(r"(?<=_C)\d+(?=\.[^.]*$)", name)
    return str(int(m.group())) if m else None


def test_components_against_brute_force(spark, rows):
    rng = random.Random(4)
    data = photos(spark, rng)
    tags = [[[data[1][2], "./" + data[7][2]], [data[3][2]], []], [[data[9][2].replace("/", "\\"), "nowhere", data[50][2] + " "]], None, [["nowhere", data[60][2]], ["nowhere", data[61][2]]]]
    tag = spark.createDataFrame([(t,) for t in tags], "member_groups array<array<string>>")
    df = spark.createDataFrame([*data, *data[:10]], PHOTO)
    p, _ = entity_splits.photo_components(df, tag)
    keys = {}
    for r in data:
        board = r[3] or r[2].split("/")[1]
        if r[8]:
            keys.setdefault(("g", r[8]), set()).add(r[0])
        if r[4]:
            keys.setdefault(("p", board, r[4], r[5], r[1].lower()), set()).add(r[0])
            if (n := number(r[6], r[1])) is not None:
                keys.setdefault(("n", board, r[4], n), set()).add(r[0])
    keys["t1"], keys["t2"] = {1, 7}, {9, 50}
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for members in keys.values():
        for a, b in itertools.pairwise(sorted(members)):
            parent[find(a)] = find(b)
    want = {(a[8], b[8]) for a in data for b in data if a[8] and b[8] and a[8] < b[8] and find(a[0]) == find(b[0])}
    assert set(rows(entity_splits.linked_groups(p))) == want
    assert p.select("photo_id", "component").distinct().count() == len(data)


def test_splits_keep_components(spark):
    df = spark.range(6000).select(F.concat(F.lit("c"), (F.col("id") % 900)).alias("component"), F.expr("element_at(array('normal','spike','excess'), cast(id % 3 + 1 as int))").alias("class_name"), "id")
    out = entity_splits.entity_splits(df, "component", "class_name", {"train": 0.6, "val": 0.2, "test": 0.2})
    assert out.groupBy("component").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    got = {r["split"]: r["n"] / 6000 for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(got["train"] - 0.6) < 0.05 and abs(got["val"] - 0.2) < 0.05
    assert out.exceptAll(entity_splits.entity_splits(df.repartition(5), "component", "class_name", {"train": 0.6, "val": 0.2, "test": 0.2})).count() == 0
    assert entity_splits.entity_splits(df.limit(0), "component", "class_name", {"train": 1, "test": 1}).count() == 0


def test_null_component_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, "x", 1), ("a", None, 2)], "component string, n string, s int")
    out = entity_splits.entity_splits(df, "component", "n", {"train": 1, "test": 1})
    assert out.count() == 3 and out.where("component is null").select("split").distinct().count() == 1


def test_empty_tables(spark):
    tag = spark.createDataFrame([], "member_groups array<array<string>>")
    p, _ = entity_splits.photo_components(spark.createDataFrame([], PHOTO), tag)
    assert p.count() == 0 and entity_splits.linked_groups(p).count() == 0


def flip(h, bits):
    return f"{int(h, 16) ^ sum(1 << b for b in bits):064x}"


def test_overlap_against_brute_force(spark, rows):
    rng = random.Random(6)
    data = photos(spark, rng, 100)
    for i in range(0, 100, 5):  # near copies at distances around the limit
        data[i] = data[i][:7] + (flip(data[i - 1][7], rng.sample(range(256), rng.choice([0, 9, 10, 11]))), data[i][8])
    data[3] = data[3][:7] + ("0" * 64,) + data[3][8:]
    data[4] = data[4][:7] + ("0x" + "0" * 64,) + data[4][8:]
    data[6] = data[6][:7] + ("short",) + data[6][8:]
    split = {r[0]: rng.choice(["train", "TRAINING ", "val", "Test", None, "holdout"]) for r in data}
    crops = spark.createDataFrame([(r[2], split[r[0]]) for r in data for _ in range(2)], "dataset_path string, split string")
    got = overlap.cross_split_pairs(spark.createDataFrame(data, PHOTO), crops)
    side = {"train": "t", "TRAINING ": "t", "val": "e", "Test": "e"}

    def near(a, b):
        ok = lambda h: len(h) == 64 and int(h, 16)
        return ok(a) and ok(b) and bin(int(a, 16) ^ int(b, 16)).count("1") <= 10

    want = set()
    for a in data:
        for b in data:
            s = (side.get(split[a[0]]), side.get(split[b[0]]))
            ba, bb = a[3] or a[2].split("/")[1], b[3] or b[2].split("/")[1]
            if s == ("t", "e") and ba == bb and a[4] and a[4] == b[4]:
                na, nb = number(a[6], a[1]), number(b[6], b[1])
                if (a[8] and a[8] == b[8]) or (na is not None and na == nb) or a[1].lower() == b[1].lower() or near(a[7], b[7]):
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert want
    exact = got.where(" or ".join(overlap.EXACT))
    assert set(rows(overlap.exact_pairs(got))) == want
    assert overlap.overlap_report(exact).agg(F.sum("pairs")).first()[0] == len(want)
    assert overlap.cross_split_pairs(spark.createDataFrame([], PHOTO), crops).count() == 0


def test_equal_only_after_normalisation(spark, rows):
    """Spellings of one group or name are a reason of their own, which the exact pairs leave out; hot keys lose nothing."""
    facts = lambda i, name, group, path: (i, name, path, "A", "R1", "V2", None, None, group)
    data = [facts(1, "Img-01.jpg", "G_7", "p1"), facts(2, "img 01.JPG", None, "p2"), facts(3, "x.jpg", "g 7", "p3"), facts(4, "y.jpg", "G_7", "p4"), facts(5, "--", "??", "p5"), facts(6, "-", "?", "p6"), facts(7, "-", "q", "p7")]
    crops = spark.createDataFrame([(f"p{i}", "train" if i in (1, 5, 7) else "val") for i in range(1, 8)], "dataset_path string, split string")
    got = overlap.cross_split_pairs(spark.createDataFrame(data, PHOTO), crops)
    flags = {(r["photo_id_a"], r["photo_id_b"]): {k for k in overlap.REASONS if r[k]} for r in got.collect()}
    assert flags == {(1, 2): {"alike_name"}, (1, 3): {"alike_group"}, (1, 4): {"same_group"}, (6, 7): {"same_name"}}
    assert rows(overlap.exact_pairs(got)) == [(1, 4), (6, 7)]
    report = overlap.overlap_report(got).first()
    assert (report["pairs"], report["pairs_alike_name"], report["pairs_alike_group"], report["photos"]) == (4, 1, 1, 4)


def test_pairs_of_a_hot_group(spark, monkeypatch):
    from jointmill.operators import joins

    monkeypatch.setattr(joins.many_to_many, "__defaults__", (50,))
    n = 120
    df = spark.range(n).select(F.col("id").alias("photo_id"), F.format_string("%d.jpg", "id").alias("image_name"), F.format_string("D/A/R1/V2/%d.jpg", "id").alias("dataset_path"), F.lit("A").alias("board"), F.lit("R1").alias("package"), F.lit("V2").alias("viewpoint"), F.lit(None).cast("string").alias("component_hint"), F.lit("ab" * 32).alias("fingerprint"), F.lit("hot").alias("group_id"))
    crops = df.select("dataset_path", F.when(F.col("photo_id") % 3 == 0, "val").otherwise("train").alias("split"))
    assert overlap.exact_pairs(overlap.cross_split_pairs(df, crops)).count() == 40 * 80
    p, _ = entity_splits.photo_components(df.withColumn("group_id", F.format_string("g%03d", "photo_id")).withColumn("component_hint", F.lit("C9")), spark.createDataFrame([], "member_groups array<array<string>>"))
    assert entity_splits.linked_groups(p).count() == n * (n - 1) // 2
    assert entity_splits.component_groups(p).select("component").distinct().count() == 1


def test_canonical(spark):
    got = spark.createDataFrame([("  A--b_C,\n d ",), ("",), (None,)], "t string").select(overlap.canonical(F.col("t")).alias("c"))
    assert [r["c"] for r in got.collect()] == ["a b c d", "", None]
