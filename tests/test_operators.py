import random

import pytest
from pyspark.sql import functions as F

from jointmill.functions import scores
from jointmill.operators import components, grouping, guards, inventory, joins, metrics, sampling, similarity, splits, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_random(spark, rows, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = components.connected_components(frame(spark, edges, "a bigint, b bigint"))
    assert dict(rows(got, "node", "root")) == union_find(edges)


def test_components_odd(spark, rows):
    assert rows(components.connected_components(frame(spark, [], "a string, b string"))) == []
    odd = [("x", None), (None, None), ("q", "q"), ("b", "a"), ("b", "a"), ("a", "b")]
    assert rows(components.connected_components(frame(spark, odd, "a string, b string")), "node", "root") == [("a", "a"), ("b", "a"), ("q", "q")]


def test_components_hub(spark):
    hub = frame(spark, [(0, i) for i in range(1, 30000)], "a bigint, b bigint")
    assert components.connected_components(hub).select("root").distinct().count() == 1


SWEEP = [(0.95, 1), (0.80, 1), (0.70, 0), (0.60, 1), (0.40, 0), (0.20, 1), (0.10, 0)]


def test_sweep(spark, rows):
    df = frame(spark, [*SWEEP, (None, 1), (float("nan"), 0)], "score double, defect int")
    s = metrics.threshold_sweep(df, "score", F.col("defect") == 1)
    got = {r["threshold"]: (r["miss"], r["far"]) for r in s.collect()}
    third = 1 / 3
    want = {0.95: (3 / 4, 0), 0.8: (2 / 4, 0), 0.7: (2 / 4, third), 0.6: (1 / 4, third), 0.4: (1 / 4, 2 * third), 0.2: (0, 2 * third), 0.1: (0, 1)}
    assert {k: (round(a, 9), round(b, 9)) for k, (a, b) in got.items()} == {k: (round(a, 9), round(b, 9)) for k, (a, b) in want.items()}
    keyed = s.withColumn("k", F.lit(1))
    assert [r["threshold"] for r in metrics.operating_points(keyed, [0.25, 0.0], ["k"]).orderBy(F.desc("max_miss")).collect()] == [0.6, 0.2]
    assert metrics.auroc(keyed, ["k"]).first()["auroc"] == 0.75


def test_sweep_one_class(spark):
    df = frame(spark, [("r", 0.5, 1), ("r", 0.4, 1)], "run string, score double, defect int")
    s = metrics.threshold_sweep(df, "score", F.col("defect") == 1, ["run"])
    assert metrics.auroc(s, ["run"]).first()["auroc"] is None
    assert {r["far"] for r in s.collect()} == {0.0}


def test_auroc_brute(spark):
    rng = random.Random(3)
    data = [(rng.randrange(12) / 10, rng.randrange(2)) for _ in range(200)]
    s = metrics.threshold_sweep(frame(spark, data, "score double, d int"), "score", F.col("d") == 1).withColumn("k", F.lit(0))
    pos, neg = [x for x, d in data if d], [x for x, d in data if not d]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(metrics.auroc(s, ["k"]).first()["auroc"] - want) < 1e-12


def test_confusion_dense(spark, rows):
    c = metrics.confusion(frame(spark, [(0, 0), (0, 1), (3, 3)], "t int, p int"), "t", "p")
    assert c.count() == 16 and c.agg(F.sum("n")).first()[0] == 3
    assert dict(rows(metrics.recalls(c), "truth", "recall")) == {0: 0.5, 1: 0.0, 2: 0.0, 3: 1.0}
    assert rows(metrics.mistakes(c), "rank", "truth", "pred", "n") == [(1, 0, 1, 1)]


def test_mean_std(spark, rows):
    df = frame(spark, [("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 2.0), ("b", None)], "o string, v double")
    assert rows(metrics.mean_std(df, ["v"], ["o"]), "o", "n", "v_mean", "v_std") == [("a", 3, 2.0, 2.0**0.5), ("b", 2, 2.0, None)]


def boxes(spark, items):
    return frame(spark, [(i, img, cls, float(x - h), 0.0, float(x + h), 10.0) for i, (img, cls, x, h) in enumerate(items)], "id int, img string, class string, x0 double, y0 double, x1 double, y1 double")


def test_largest_gap(spark, rows):
    df = frame(spark, [(0, "p", 20.0), (1, "p", 35.0), (2, "p", 310.0), (3, "q", 5.0), (4, "r", 1.0), (5, "r", 1.0)], "id int, img string, x double")
    assert rows(windows.largest_gap_clusters(df, ["img"], "x", "id"), "id", "cluster") == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 1), (5, 2)]


def test_merged_joints(spark, rows):
    df = boxes(spark, [("p", "excess", 20, 10), ("p", "spike", 35, 10), ("p", "normal", 310, 5), ("q", "normal", 20, 10), ("q", "normal", 20, 15), ("q", "excess", 900, 5)])
    j = windows.merged_joints(df, ["img"], "class", "id", ["x0", "y0", "x1", "y1"])
    assert rows(j, "img", "class", "merged_from", "x0", "x1", "polygon_rank_x", "joint_position") == [
        ("p", "normal", "", 305.0, 315.0, 2, "right"), ("p", "spike", "spike+excess", 10.0, 45.0, 1, "left"),
        ("q", "excess", "", 895.0, 905.0, 2, "right"), ("q", "normal", "normal+normal", 5.0, 35.0, 1, "left"),
    ]


def test_hamming_pairs(spark, rows):
    rng = random.Random(5)
    base = [rng.getrandbits(256) for _ in range(12)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(256), rng.choice([1, 9, 10, 11]))) for b in base for _ in range(3)] + base[:3]
    df = frame(spark, [(i, "c", f"{p:064x}") for i, p in enumerate(prints)] + [(99, "c", None)], "id int, cell string, print string")
    for limit in (10, 40):
        want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= limit}
        assert set(rows(similarity.hamming_pairs(df, ["cell"], "id", "print", limit), "item_a", "item_b")) == want


def test_hot_parts_are_cut_further(spark, rows, monkeypatch):
    """Prints that share dark corners: hot parts at every level, and pairs at and around the limit."""
    rng = random.Random(9)
    base = [(rng.getrandbits(64) << 192) if k % 2 else rng.getrandbits(256) for k in range(20)]
    prints = list({p: 0 for b in base for p in (b, *(b ^ sum(1 << k for k in rng.sample(range(256), n)) for n in (1, 9, 10, 11, 12)))})
    cls = frame(spark, [("c", f"{p:064x}") for p in prints] + [("d", f"{p:064x}") for p in prints[:30]], "cell string, p string").withColumn("w", scores.print_words("p"))
    cls = cls.select(similarity.print_class(["cell"]).alias("id"), F.xxhash64("cell").alias("block"), "w", F.concat("cell", "p").alias("name"))
    want = {(f"{c}{p:064x}", f"{c}{q:064x}") for c, ps in (("c", prints), ("d", prints[:30])) for p in ps for q in ps if bin(p ^ q).count("1") <= 10}
    name = {tuple(r["id"]): r["name"] for r in cls.collect()}
    for part_pairs in (1 << 30, 40, 1):
        got = [(name[tuple(r["ida"])], name[tuple(r["idb"])]) for r in similarity.near_classes(cls, cls, 10, part_pairs=part_pairs).collect()]
        assert set(got) == want and len(got) == len(want)


def test_many_to_many(spark, rows):
    left = frame(spark, [("h", i) for i in range(300)] + [("c", 1), (None, 2)], "k string, a int")
    right = frame(spark, [("h", i) for i in range(200)] + [("c", 5), ("x", 6), (None, 7)], "k string, b int")
    want = left.join(right, "k")
    for task_pairs in (1 << 30, 1000, 1):
        got = joins.many_to_many(left, right, ["k"], task_pairs)
        assert got.columns == want.columns and rows(got) == rows(want)


@pytest.mark.parametrize("tile", [5, 1024])
def test_tiles(spark, rows, tile):
    rng = random.Random(5)
    prints = [rng.getrandbits(256) for _ in range(40)]
    df = frame(spark, [(i, "cd"[i % 3 == 0], f"{p:064x}") for i, p in enumerate([*prints, *prints[:5]])], "id int, cell string, print string")
    every = [*prints, *prints[:5]]
    want = {(i, j) for i in range(45) for j in range(i + 1, 45) if (i % 3 == 0) == (j % 3 == 0) and bin(every[i] ^ every[j]).count("1") <= 120}
    got = rows(similarity.hamming_pairs(df, ["cell"], "id", "print", 120, tile=tile), "item_a", "item_b")
    assert sorted(got) == sorted(want)
    v = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(45)]
    vec = frame(spark, [(i, "cd"[i % 3 == 0], x) for i, x in enumerate(v)], "id int, cell string, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5  # noqa: E731, B905
    want = {(i, j) for i in range(45) for j in range(i + 1, 45) if (i % 3 == 0) == (j % 3 == 0) and cos(v[i], v[j]) >= 0.2}
    assert sorted(rows(similarity.cosine_pairs(vec, ["cell"], "id", "v", 0.2, tile=tile), "item_a", "item_b")) == sorted(want)


def test_cosine_pairs(spark, rows):
    df = frame(spark, [(0, "c", [1.0, 0.0]), (1, "c", [7.0, 0.0]), (2, "c", [0.0, 1.0]), (3, "d", [1.0, 0.0]), (4, "c", None)], "id int, cell string, v array<double>")
    assert rows(similarity.cosine_pairs(df, ["cell"], "id", "v", 0.99), "item_a", "item_b") == [(0, 1)]
    assert len(rows(similarity.cosine_pairs(df, ["cell"], "id", "v", -1.0))) == 3


def test_group_ids(spark, rows):
    df = frame(spark, [("z.jpg",), ("a.jpg",)], "path string").withColumn("root", F.col("path"))
    assert rows(grouping.group_ids(df, "root", "path", "phash"), "path", "group_id") == [("a.jpg", "phash_001"), ("z.jpg", "phash_002")]


def test_hand_made_groups(spark, rows):
    sets = frame(spark, [(["a", "b"],), (["b", "c"],), (["x"],), (["p", "q"],), (None,), ([],)], "members array<string>")
    g = grouping.canonical_groups(sets, "members")
    assert rows(g, "root", "members") == [("a", ["a", "b", "c"]), ("p", ["p", "q"])]
    assert rows(grouping.linked(g, "c", "q"), "members") == [(["a", "b", "c", "p", "q"],)]
    assert rows(grouping.unlinked(g, "p"), "members") == [(["a", "b", "c"],)]
    assert rows(grouping.without_cell(g, F.array(F.lit("p"), F.lit("q"))), "root") == [("a",)]


IMAGES = [("a", "CS1/R0805", "V2", "1"), ("b", "CS1/R0805", "V2", None), ("c", "CS1/R0805", "V2.1", "1"), ("d", "CS1/R0805", "V2.1", None), ("e", "CS2/R0603", "V2", None)]


def test_measures(spark):
    df = frame(spark, IMAGES, "id string, cell string, viewpoint string, hint string").withColumn("g", F.when(F.col("id").isin("a", "c"), "x").otherwise(F.col("id")))
    m = grouping.measured(df, ["g"], "cell", "viewpoint", "hint").first().asDict()
    assert (m["groups"], m["largest"], m["singletons"], m["violations"], m["references"], m["merged"], m["partnered"], m["ceiling"], m["partner_rate"]) == (4, 2, 3, 0, 1, 1, 2, 4, 0.5)


def test_guessed_pairs(spark, rows):
    df = frame(spark, IMAGES, "id string, cell string, viewpoint string, hint string")
    assert rows(grouping.guessed_pairs(df, "cell", "viewpoint", ["id"], "id"), "left_item", "right_item") == [("a", "c"), ("b", "d")]
    tagged = frame(spark, [("a",)], "id string")
    assert rows(grouping.guessed_pairs(df, "cell", "viewpoint", ["id"], "id", tagged), "left_item", "right_item") == [("b", "d")]


def test_fold_counts():
    assert splits.fold_counts((0.6, 0.2, 0.2)) == (5, 3, 1, 1)
    assert splits.fold_counts((0.5, 0.25, 0.25)) == (4, 2, 1, 1)
    with pytest.raises(ValueError):
        splits.fold_counts((0.61, 0.19, 0.2))


def test_choose(spark):
    classes = ("normal", "excess", "insufficient", "spike")
    df = frame(spark, [(f"g{g}", classes[g % 4], i) for g in range(200) for i in range(4)], "g string, class string, i int")
    out, choice = splits.choose(df, "g", "class", number=60)
    assert splits.leaks(out, "g").count() == 0 and choice.accepted >= 1 and choice.considered == 60
    again, same = splits.choose(df.repartition(7), "g", "class", number=60)
    assert same == choice and again.exceptAll(out).count() == 0
    starved = frame(spark, [(f"g{g}", ("excess", "spike", "insufficient")[g % 3], 0) for g in range(60)] + [("n", "normal", 0)], "g string, class string, i int")
    with pytest.raises(ValueError):
        splits.choose(starved, "g", "class", number=20)


def test_split_hash(spark):
    import hashlib

    df = frame(spark, [("s", "b", "val"), ("s", "a", "train")], "seed string, id string, split string")
    assert splits.split_hash(df, "id", "split", ["seed"]).first()["split_hash"] == hashlib.sha256(b"a,train\nb,val").hexdigest()
    f = lambda d: splits.split_fingerprint(d, "id", "split", ["seed"]).first()["fingerprint"]
    assert f(df) == f(df.orderBy("id"))


def test_class_weights(spark, rows):
    df = frame(spark, [("normal", 39), ("excess", 93), ("insufficient", 34), ("spike", 72)], "c string, n int")
    got = dict(rows(sampling.class_weights(df, "c", "n"), "c", "weight"))
    assert {k: round(v, 8) for k, v in got.items()} == {"normal": 1.28696802, "excess": 0.53969627, "insufficient": 1.47622803, "spike": 0.69710768}
    got = dict(rows(sampling.class_weights(df, "c", "n", "effective", 0.999), "c", "weight"))
    assert {k: round(v, 8) for k, v in got.items()} == {"normal": 1.27978749, "excess": 0.55121653, "insufficient": 1.46434660, "spike": 0.70464937}
    assert set(dict(rows(sampling.class_weights(df, "c", "n", "effective", 0), "c", "weight")).values()) == {1.0}
    with pytest.raises(ValueError):
        sampling.class_weights(df, "c", "n", "effective", 1.0)


def test_samples(spark, rows):
    df = spark.range(500).withColumn("s", F.col("id") % 2)
    a = rows(sampling.seeded_sample(df, "id", 10, 1, ["s"]), "id")
    assert a == rows(sampling.seeded_sample(df.repartition(5), "id", 10, 1, ["s"]), "id") and len(a) == 20
    w = frame(spark, [(0, 3.0), (1, 1.0)], "s bigint, weight double")
    drawn = sampling.weighted_sample(df, "id", "s", w, 4000, 1)
    share = drawn.where("s = 0").count() / drawn.count()
    assert drawn.count() == 4000 and abs(share - 0.75) < 0.04


def test_resolution(spark, rows):
    ann = frame(spark, [(1, "a.jpg", "L"), (2, "b.jpg", "L"), (3, "c.jpg", "L"), (4, "d.jpg", "L")], "id int, name string, own string")
    files = frame(spark, [("a.jpg", "L", "L/a.jpg"), ("a.jpg", "D/V2", "D/V2/a.jpg"), ("a.jpg", "D/V2.1", "D/V2.1/a.jpg"), ("b.jpg", "L", "L/b.jpg"), ("d.jpg", "L", "L/d.jpg"), ("d.jpg", "M", "M/d.jpg")], "name string, folder string, path string")
    got = rows(joins.resolve_prefer_elsewhere(ann, files, "name", "own"), "id", "resolved_path", "ambiguous")
    assert got == [(1, "D/V2/a.jpg", True), (2, "L/b.jpg", False), (3, None, False), (4, "M/d.jpg", False)]


def test_joins(spark, rows):
    a, b = frame(spark, [("x", 1), ("y", 2)], "k string, v int"), frame(spark, [("x", 5), ("z", 6)], "k string, w int")
    assert rows(joins.orphans(a, b, ["k"])) == [("y",)]
    assert rows(joins.symmetric_difference(a, b, ["k"])) == [("y", "left_only"), ("z", "right_only")]
    assert rows(joins.left_with_default(a, b, ["k"], {"w": 0}), "k", "w") == [("x", 5), ("y", 0)]
    with pytest.raises(Exception, match="no crop: y"):
        joins.guarded_inner(a, b, ["k"], "crop").collect()
    hot = frame(spark, [("h", i) for i in range(15000)] + [("c", 1)], "k string, i int")
    keys = hot.groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.length("k"))
    assert joins.skew_safe_lookup(hot, keys, "k", "n", 15001).count() == 15001
    assert joins.skew_safe_lookup(hot, keys, "k", "n", 15001, task_rows=1000).count() == 15001
    assert joins.skew_safe_lookup(hot.limit(50), keys, "k", "n", 50).count() == 50


def test_scope_removes_what_it_wrote(spark):
    import os

    from jointmill.session import dropped, scope, written

    at = lambda df: df._jointmill_path.removeprefix("file://")
    with scope(spark):
        a, b = written(spark.range(3)), written(spark.range(4))
        assert a.count() == 3 and os.path.isdir(at(a))
        dropped(a)
        assert not os.path.isdir(at(a)) and b.count() == 4
    assert not os.path.isdir(at(b))
    kept = written(spark.range(2))
    assert kept.count() == 2


def test_guards(spark):
    df = frame(spark, [("a", 1), ("a", 2), (None, 3)], "k string, v int")
    assert guards.missing_columns(df, ["k", "z"]) == ["z"]
    with pytest.raises(ValueError, match="lacks"):
        guards.require_columns(df, ["z"])
    with pytest.raises(ValueError, match="occurs 2 times"):
        guards.require_unique(df, ["k"])
    assert guards.outside_domain(df, "k", ["a"]).first()["n"] == 1
    with pytest.raises(Exception, match="not allowed"):
        guards.require_domain(df, "k", ["a"]).collect()
    with pytest.raises(ValueError):
        guards.require_rows(df.limit(0))


def test_inventory(spark, rows):
    files = frame(spark, [("Dataset/CS1/R0805/V2/WIN_1.jpg",), ("Labeled/WIN_1.jpg",), ("Dataset/CS1/R0805/V2.1/WIN_2_x.PNG",), ("a/notes.txt",)], "path string")
    d = inventory.described(files)
    assert rows(d, "path", "is_image", "task", "in_scope")[2] == ("Labeled/WIN_1.jpg", True, None, None)
    assert rows(inventory.deepest(d, "name", "path"), "name", "path", "set_aside")[0] == ("WIN_1.jpg", "Dataset/CS1/R0805/V2/WIN_1.jpg", 1)
    p = inventory.position_table(d, inventory.name_tokens("stem"), "path")
    assert rows(p, "position", "distinct", "role", "examples")[0] == (0, 2, "grouping", "WIN|notes")
    assert rows(inventory.token_outliers(d, inventory.name_tokens("stem"), "path"), "path", "n_tokens") == [("Dataset/CS1/R0805/V2.1/WIN_2_x.PNG", 3), ("a/notes.txt", 1)]
