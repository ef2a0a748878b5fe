import math

import pytest

from jointmill.plans import options


def test_seeds_and_values():
    assert options.seeds_of("0,1 2") == options.seeds_of("0", "1", "2") == [0, 1, 2]
    assert options.values_of("a.b = x, y") == ("a.b", ["x", "y"])
    for bad in ("", "1,1", "x"):
        with pytest.raises(ValueError):
            options.seeds_of(bad)
    for bad in ("seed=1", "a", "=1", "a=", "a=x,x"):
        with pytest.raises(ValueError):
            options.values_of(bad)


def test_jobs(spark):
    got = [(r["seed"], r["option"]) for r in options.jobs(spark, [5, 3], "m=a,b", "n=1,2").orderBy("job").collect()]
    assert [s for s, _ in got] == [5] * 4 + [3] * 4 and got[1][1] == {"m": "a", "n": "2"} and got[2][1] == {"m": "b", "n": "1"}
    assert [r["option"] for r in options.jobs(spark, [1]).collect()] == [{}]
    with pytest.raises(ValueError):
        options.jobs(spark, [1], "m=a", "m=b")


def test_settings(tmp_path):
    s = options.settings({"epochs": 3, "imbalance": {"beta": 0.5}}, ("lr=0.1", "imbalance.mode=weighted_sampler"))
    assert (s["epochs"], s["imbalance.beta"], s["lr"], s["imbalance.mode"], s["batch_size"]) == (3, 0.5, 0.1, "weighted_sampler", 32)
    for bad, error in (({"nope": 1}, KeyError), ({"epochs": 0}, ValueError), ({"epochs": "many"}, ValueError), ({"imbalance": {"beta": 1.0}}, ValueError), ({"epochs": 1.5}, TypeError)):
        with pytest.raises(error):
            options.settings(bad)
    (tmp_path / "t.yaml").write_text("classes: {good: normal}\nexclude: [no_good]\n")
    assert options.load_taxonomy(str(tmp_path / "t.yaml")) == ({"good": "normal"}, {"no_good"})
    (tmp_path / "s.yaml").write_text("seed: 7\n")
    assert options.load_settings(str(tmp_path / "s.yaml"))["seed"] == 7


def test_texts(spark):
    assert options.threshold_of("phash", 99.9) == 99 and [options.threshold_of(m) for m in ("coarse", "phash", "embed")] == [None, 10, 0.98]
    assert [options.tolerance_of(t, 0.5) for t in (None, "full", "x", "-1", "2")] == [0.5, None, 0.5, 0.0, 2.0]
    assert options.mean_std_text(0.8125, 0.034, 3, 2) == "0.812 ± 0.034 (1 n/a)"
    assert options.mean_std_text(0.5, None, 1, 1) == "0.500 ± —" and options.mean_std_text(math.nan, None, 2, 0) == "n/a"
    df = spark.createDataFrame([("b", 1.0), ("a", None)], "o string, v double")
    assert options.markdown(df, ["o"]) == "| o | v |\n| --- | --- |\n| a |  |\n| b | 1.000 |"
