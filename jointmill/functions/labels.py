"""Class, split and option labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jointmill.functions.paths import col, trimmed

#: Classes by number, raw label to class, precedence when records are merged.
CLASSES = ("normal", "excess", "insufficient", "spike")
RAW_TO_CLASS = {"good": "normal", "exc_solder": "excess", "poor_solder": "insufficient", "spike": "spike"}
PRECEDENCE = ("insufficient", "spike", "excess", "normal")
#: Spellings of a split.
SPLITS = {"train": ("train", "training"), "val": ("val", "valid", "validation"), "test": ("test", "testing")}


def joint_class(c: Column | str) -> Column:
    """Class named by a class or raw label, whatever its case and surrounding blanks; null for anything else."""
    x = F.lower(trimmed(c))
    out = None
    for name in CLASSES:
        names = sorted({name, *(r for r, k in RAW_TO_CLASS.items() if k == name)})
        out = F.when(x.isin(names), name) if out is None else out.when(x.isin(names), name)
    return out


def split_name(c: Column | str) -> Column:
    """train, val or test of any of their spellings; null for anything else."""
    x = F.lower(trimmed(c))
    out = None
    for name, names in SPLITS.items():
        out = F.when(x.isin(list(names)), name) if out is None else out.when(x.isin(list(names)), name)
    return out


def precedence(c: Column | str) -> Column:
    """Place of a class in the merge order, from 0; null for no class."""
    c = col(c)
    out = None
    for i, name in enumerate(PRECEDENCE):
        out = F.when(c == name, i) if out is None else out.when(c == name, i)
    return out


def class_at(place: Column | str) -> Column:
    """Inverse of precedence()."""
    place = col(place)
    out = None
    for i, name in enumerate(PRECEDENCE):
        out = F.when(place == i, name) if out is None else out.when(place == i, name)
    return out


def class_number(c: Column | str) -> Column:
    c = col(c)
    out = None
    for i, name in enumerate(CLASSES):
        out = F.when(c == name, i) if out is None else out.when(c == name, i)
    return out


def option_label(options: Column | str) -> Column:
    """Sorted `k=v` list of a map, or `(none)` for an empty or null map."""
    entries = F.array_sort(F.map_entries(col(options)))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.when(F.coalesce(F.size(F.map_keys(col(options))), F.lit(0)) > 0, text).otherwise(F.lit("(none)"))


def position_name(rank: Column, total: Column) -> Column:
    """left for the first joint, right for the last of several, else middle."""
    return F.when(rank == 1, "left").when(rank == total, "right").otherwise("middle")
