"""Option grids of experiments, their settings, and numbers as text."""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default thresholds of the grouping methods: none, bits of 256, cosine.
THRESHOLDS = {"coarse": None, "phash": 10.0, "embed": 0.98}

#: Settings of a training run with their defaults, and what a value must satisfy.
SETTINGS: dict[str, tuple[object, object]] = {
    "model": ("resnet50.a1_in1k", lambda v: bool(v)),
    "optimizer": ("sgd", lambda v: v in ("sgd", "adam")),
    "lr": (0.01, lambda v: v > 0),
    "epochs": (10, lambda v: v >= 1),
    "batch_size": (32, lambda v: v >= 1),
    "num_workers": (2, lambda v: v >= 0),
    "seed": (0, lambda v: 0 <= v < 1 << 32),
    "imbalance.mode": ("none", lambda v: v in ("none", "class_weighted_loss", "weighted_sampler")),
    "imbalance.weight_scheme": ("inverse_freq", lambda v: v in ("inverse_freq", "effective_number")),
    "imbalance.beta": (0.999, lambda v: 0 <= v < 1),
}


def _no_repeats(values: list, what: str) -> list:
    twice = sorted({str(v) for v in values if values.count(v) > 1})
    if not values or twice:
        raise ValueError(f"{what}: " + (f"{', '.join(twice)} given twice" if twice else "nothing given"))
    return values


def seeds_of(*texts: str) -> list[int]:
    """Whole numbers separated by commas or blanks, over one or several texts; none may repeat."""
    return _no_repeats([int(t) for t in re.split(r"[,\s]+", " ".join(texts).strip()) if t], "seeds")


def values_of(text: str) -> tuple[str, list[str]]:
    """Key and values of `key=a,b,c`; seeds have an argument of their own."""
    m = re.fullmatch(r"\s*([^=\s]+)\s*=(.*)", text, re.DOTALL)
    if not m or m[1] == "seed":
        raise ValueError(f"not key=value,...: {text}")
    return m[1], _no_repeats([v.strip() for v in m[2].split(",") if v.strip()], m[1])


def jobs(spark: SparkSession, seeds: list[int], *sets: str) -> DataFrame:
    """(job, seed, option): all values with all seeds; every option comes with the first seed before any with the next."""
    grid = spark.createDataFrame(list(enumerate(seeds)), "s int, seed bigint").withColumns({"option": F.create_map().cast("map<string,string>"), "o": F.lit(0)})
    keys = _no_repeats([values_of(s)[0] for s in sets], "sets") if sets else []
    for key, text in zip(keys, sets, strict=True):
        values = values_of(text)[1]
        v = spark.createDataFrame(list(enumerate(values)), "v int, value string")
        grid = grid.crossJoin(F.broadcast(v)).select("s", "seed", F.map_concat("option", F.create_map(F.lit(key), F.col("value"))).alias("option"), (F.col("o") * len(values) + F.col("v")).alias("o"))
    many = 1
    for s in sets:
        many *= len(values_of(s)[1])
    return grid.select((F.col("s") * many + F.col("o")).alias("job"), "seed", "option")


def settings(given: dict, overrides: tuple[str, ...] = ()) -> dict[str, object]:
    """Settings with nested or dotted keys over the defaults, and `key=value` texts over both; unknown or wrong ones are refused."""
    flat: dict[str, object] = {}
    for k, v in given.items():
        flat |= {f"{k}.{x}": y for x, y in v.items()} if isinstance(v, dict) else {k: v}
    for text in overrides:
        k, _, v = text.partition("=")
        flat[k.strip()] = v.strip()
    out = {k: default for k, (default, _) in SETTINGS.items()}
    for k, v in flat.items():
        if k not in SETTINGS:
            raise KeyError(f"no such setting: {k}")
        kind = type(SETTINGS[k][0])
        if isinstance(v, bool) or (kind is int and isinstance(v, float) and v != int(v)):
            raise TypeError(f"{k} must be {kind.__name__}")
        out[k] = kind(v)
        if not SETTINGS[k][1](out[k]):
            raise ValueError(f"{k} may not be {v}")
    return out


def load_settings(path: str, overrides: tuple[str, ...] = ()) -> dict[str, object]:
    import yaml

    return settings(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}, overrides)


def load_taxonomy(path: str) -> tuple[dict[str, str], set[str]]:
    """Classes by raw label, and labels that other tasks use."""
    import yaml

    t = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return dict(t.get("classes") or {}), set(t.get("exclude") or ())


def threshold_of(method: str, given: float | None = None) -> float | int | None:
    """Given threshold or the method's own; bits are whole."""
    t = THRESHOLDS[method] if given is None else given
    return int(t) if method == "phash" and t is not None else t


def tolerance_of(text: str | None, fallback: float | None) -> float | None:
    """Crop tolerance of a request: `full` for none, what can't be read falls back, below 0 is 0."""
    if text == "full":
        return None
    try:
        return fallback if text is None else max(0.0, float(text))
    except ValueError:
        return fallback


def mean_std_text(mean: float | None, std: float | None, n: int, real: int) -> str:
    """Mean ± deviation to three places; a dash for the deviation of one value, n/a for none, and how many were left out."""
    if not real or mean is None or math.isnan(mean):
        return "n/a"
    left = f" ({n - real} n/a)" if n > real else ""
    return f"{mean:.3f} ± " + ("—" if real == 1 or std is None else f"{std:.3f}") + left


def markdown(df: DataFrame, order: list[str]) -> str:
    """A small table, such as a report's, as Markdown in the given order."""
    rows = df.orderBy(*order).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.3f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
