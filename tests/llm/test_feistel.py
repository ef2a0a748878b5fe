import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jointmill.llm.feistel import HALF, ROUNDS, broken_promises, permute_range, permuted, stable_sample


def test_bijection(spark):
    for seed in (0, 7):
        got = spark.range(4096).select(permuted(F.col("id"), seed, bits=12).alias("p"))
        assert got.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()[:] == (4096, 0, 4095)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 1000, 4096, 4097])
def test_permute_range(size):
    p = permute_range(np.arange(size), size, 11)
    assert sorted(p.tolist()) == list(range(size))
    if size > 100:
        assert (p != permute_range(np.arange(size), size, 12)).any()


def test_sample_is_stable(spark):
    few = spark.range(5000).select(F.format_string("c%d", "id").alias("i"))
    more = spark.range(9000).select(F.format_string("c%d", "id").alias("i")).repartition(9)
    ids = lambda df, rate=0.3: {r["i"] for r in stable_sample(df, "i", rate, 5).collect()}
    small, large = ids(few), ids(more)
    assert small == {i for i in large if int(i[1:]) < 5000}
    assert small < ids(few, 0.6) and abs(len(large) / 9000 - 0.3) < 0.03
    assert ids(few, 0) == set() and len(ids(few, 1)) == 5000
    assert small != {r["i"] for r in stable_sample(few, "i", 0.3, 6).collect()}


def network(up, low, seed):
    """The permutation in plain Python."""
    for turn in range(ROUNDS):
        up, low = low, up ^ int(hashlib.md5(f"{turn}:{seed}:{low}".encode()).hexdigest()[:15], 16)
    return (up << HALF) | low


@pytest.mark.parametrize("rate", [0.001, 0.3])
def test_sample_against_plain_python(spark, rate):
    def taken(i, seed):
        if isinstance(i, int):
            up, low = (i % 2**64) >> HALF, i % 2**HALF
        else:
            h = hashlib.md5(i.encode()).hexdigest()
            up, low = int(h[:15], 16), int(h[15:30], 16)
        return network(up, low, seed) < rate * 2 ** (2 * HALF)

    numbers = [*range(-500, 3000), 2**62, -(2**63)]
    df = spark.createDataFrame([(i, f"t{i}") for i in numbers], "i bigint, t string")
    assert {r["i"] for r in stable_sample(df, "i", rate, 9).collect()} == {i for i in numbers if taken(i, 9)}
    assert {r["t"] for r in stable_sample(df, "t", rate, 9).collect()} == {f"t{i}" for i in numbers if taken(f"t{i}", 9)}


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 2, 3), ("b", 1, 2, 3)], "`i.d` string, l int, r int, seed int")
    assert stable_sample(df, "i.d", 1.0, "seed").columns == df.columns and stable_sample(df, "i.d", 1.0, "seed").count() == 2


def test_sample_defined(spark):
    df = spark.createDataFrame([(None, 1), ("a", None), ("b", 1), ("b", 1)], "i string, s bigint")
    assert [r["i"] for r in stable_sample(df, "i", 1.0, "s").collect()] == ["b", "b"]
    assert stable_sample(df.limit(0), "i", 0.5, 1).count() == 0
    with pytest.raises(ValueError):
        stable_sample(df, "i", 1.5, 1)


def test_broken_promises(spark, rows):
    # c's later val has no promise before it; d is lost at 2 as its row there says nothing
    e = [(1, 0, "a", "val", 1), (1, 0, "a", "val", 1), (1, 1, "a", "train", 2), (1, 0, "b", "test", 1), (1, 0, "c", "train", 1), (1, 1, "c", "val", 2), (1, 0, "d", "val", 1), (1, 1, "d", "val", 2), (1, 2, "d", None, 3), (2, 0, "a", "val", 1), (None, 0, "a", "val", 1)]
    entries = spark.createDataFrame(e, "seed bigint, choice_index int, crop_id string, split string, frozen_at int")
    versions = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 2), (2, 0)], "seed bigint, choice_index int")
    assert rows(broken_promises(entries, versions), "choice_index", "crop_id") == [(1, "a"), (1, "b"), (2, "c"), (2, "d")]
    assert broken_promises(entries.limit(0), versions).count() == 0
