"""Top N rows of every group by simultaneous bisection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointmill.operators.joins import skew_safe_lookup
from jointmill.session import dropped, written

#: Parts into which the interval of a group that isn't settled is cut in a round.
PARTS = 32
_LARGEST = 1.7976931348623157e308
_W = "_jm_"


def _part(value: Column, lo: Column, hi: Column, parts: int) -> Column:
    """Which of `parts` equal parts of lo..hi holds the value; never falls as the value grows."""
    big = F.greatest(F.abs(lo), F.abs(hi)) > 1e300  # their difference could overflow
    x, a, b = (F.when(big, F.least(F.greatest(c, F.lit(-_LARGEST)), F.lit(_LARGEST)) / 4).otherwise(c) for c in (value, lo, hi))
    share = F.when(b > a, (x - a) / F.nullif(b - a, F.lit(0.0))).otherwise(F.lit(0.0))
    return F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(share * parts))).cast("int")


def _id_digit(identifier: Column, skip: Column) -> Column:
    """Five UTF-8 bytes after the first `skip` characters, and whether the text ends there, as a number.

    It compares like the code points, and an identifier comes before a longer one that starts with it.
    """
    rest = F.substring(F.encode(F.substr(identifier, skip + 1), "UTF-8"), 1, 6)
    bytes_ = F.conv(F.rpad(F.hex(F.substring(rest, 1, 5)), 10, "0"), 16, 10).cast("double")
    return bytes_ * 8 + F.length(rest)


def _common(a: Column, b: Column) -> Column:
    """Length of the common start of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    first = F.array_position(same, F.lit(False))
    return F.when(n == 0, F.lit(0)).when(first > 0, first - 1).otherwise(n).cast("int")


def top_n_per_group(
    rows: DataFrame, groups: list[str], score: str, identifier: str, n: int | str = 3,
    descending: Column | bool = True, parts: int = PARTS, unique: bool = False, max_rounds: int = 2000,
) -> DataFrame:
    """The n best rows of every group, all columns kept, without ever sorting or gathering a group.

    Order: by score, highest first where `descending`, else lowest first; equal scores by identifier in code-point
    order. `n` is a number or the name of a column that holds one number a group. Score and identifier digits form one
    order-preserving code; each round cuts every unsettled group's interval of the code into `parts`, counts the rows of
    all parts of all groups in one aggregation with partial sums, and keeps the part in which the n-th row lies. Rows
    before it are chosen, rows after it leave; the next round looks at the kept part only, at further bytes of the
    identifier once its scores are equal. A group is settled as soon as it holds exactly n, or has no more. Intervals
    shrink `parts` times a round, so doubles of every size are told apart in a few hundred rounds at the very worst.

    Defined results: null or NaN scores and null identifiers are no candidates. Null group values form groups of
    their own. Rows that repeat group, score and identifier count once (which of their other columns stay is settled
    by their smallest hash); pass unique=True if there are none. Groups smaller than n come out whole, n of 0 or null
    gives nothing, an empty table an empty result. Extra columns may have any name.
    """
    names, kinds = rows.columns, dict(rows.dtypes)
    code = F.col(score).cast("double")
    falls = F.lit(descending) if isinstance(descending, bool) else descending
    g = [f"{_W}g{i}" for i in range(len(groups))]
    text = kinds[identifier] == "string"
    extra = [c for c in names if c not in groups and not (text and c == identifier)]
    base = rows.where(code.isNotNull() & ~F.isnan(code) & F.col(identifier).isNotNull())
    base = base.select(
        F.struct(*[F.col(f"`{c}`") for c in extra]).alias(f"{_W}row"), *[F.col(c).alias(x) for c, x in zip(groups, g, strict=True)],
        (F.when(falls, -code).otherwise(code) + F.lit(0.0)).alias(f"{_W}k"), F.col(identifier).cast("string").alias(f"{_W}id"),
        (F.col(n) if isinstance(n, str) else F.lit(n)).cast("long").alias(f"{_W}need"),
    ).where(f"{_W}need > 0")
    if not unique:
        base = base.groupBy(*g, f"{_W}k", f"{_W}id", f"{_W}need").agg(F.min_by(f"{_W}row", F.xxhash64(f"{_W}row")).alias(f"{_W}row"))
    base = written(base, "topn-rows")
    lo, hi, total = base.agg(F.min(f"{_W}k"), F.max(f"{_W}k"), F.count("*")).first()
    done: list[DataFrame] = []
    group = F.struct(*g).alias(f"{_W}group")
    rest = base
    for turn in range(max_rounds):
        if not total:
            break
        if turn:  # each group's own interval; equal scores leave the identifier after its common start
            ends = rest.groupBy(group).agg(F.count("*").alias("c"), F.min(f"{_W}k").alias("k0"), F.max(f"{_W}k").alias("k1"), F.min(f"{_W}id").alias("i0"), F.max(f"{_W}id").alias("i1"))
            ends = ends.withColumn(f"{_W}skip", F.when(F.col("k0") == F.col("k1"), _common(F.col("i0"), F.col("i1"))))
            skip, by_id = F.col(f"{_W}skip"), F.col(f"{_W}skip").isNotNull()
            first, last = F.when(by_id, _id_digit(F.col("i0"), skip)).otherwise(F.col("k0")), F.when(by_id, _id_digit(F.col("i1"), skip)).otherwise(F.col("k1"))
            ends = ends.select(f"{_W}group", "c", skip, first.alias(f"{_W}lo"), last.alias(f"{_W}hi"))
            cut = skew_safe_lookup(rest.select(group, "*"), ends, f"{_W}group", "c", total).drop(f"{_W}group")
            digit = F.when(by_id, _id_digit(F.col(f"{_W}id"), skip)).otherwise(F.col(f"{_W}k"))
            part = _part(digit, F.col(f"{_W}lo"), F.col(f"{_W}hi"), parts)
        else:
            cut, part = base, _part(F.col(f"{_W}k"), F.lit(lo), F.lit(hi), parts)
        cut = cut.withColumn(f"{_W}p", part)
        if turn:
            cut = written(cut, "topn-cut")  # read three times, with a plan of its own
        counts = cut.groupBy(*g, f"{_W}p").agg(F.count("*").alias("c"), F.max(f"{_W}need").alias("need"))
        before = Window.partitionBy(*g).orderBy(f"{_W}p").rowsBetween(Window.unboundedPreceding, -1)
        chosen = counts.withColumn("above", F.coalesce(F.sum("c").over(before), F.lit(0))).where("above < need")
        key = F.struct(*g, f"{_W}p").alias(f"{_W}key")
        chosen = chosen.select(key, "c", (F.col("above") + F.col("c") <= F.col("need")).alias(f"{_W}in"), (F.col("need") - F.col("above")).alias(f"{_W}left"))
        near = cut.select(key, f"{_W}row", f"{_W}k", f"{_W}id")
        step = skew_safe_lookup(near, chosen, f"{_W}key", "c", total)
        step = written(step.select(*[F.col(f"{_W}key.{x}").alias(x) for x in g], f"{_W}row", f"{_W}k", f"{_W}id", f"{_W}in", F.col(f"{_W}left").alias(f"{_W}need")), "topn-step")
        done.append(step.where(f"{_W}in"))
        rest = step.where(f"not {_W}in").drop(f"{_W}in")
        dropped(cut if turn else base)
        total = rest.count()
    else:
        raise RuntimeError(f"bisection did not settle in {max_rounds} rounds")
    if not done:
        dropped(base)
        return rows.limit(0)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    back = {c: F.col(x) for c, x in zip(groups, g, strict=True)} | ({identifier: F.col(f"{_W}id")} if text else {})
    return out.select(*[back.get(c, F.col(f"{_W}row.`{c}`")).alias(c) for c in names])
