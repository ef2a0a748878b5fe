"""Samples that stay as data grows: a keyed permutation of a fixed identifier domain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.paths import col

#: The identifier domain is 0 .. 2**(2 * HALF) - 1; a number is held as its upper and lower half.
HALF = 60
ROUNDS = 4
_UP, _LOW, _SEED = "_jm_up", "_jm_low", "_jm_seed"


def digest_number(text: Column, digits: int = 15, at: int = 1) -> Column:
    """Hex digits of the text's MD5 as a number: any engine can compute it."""
    return F.conv(F.substring(F.md5(text), at, digits), 16, 10).cast("long")


def _turned(half: Column, seed: Column, turn: Column | int, bits: int) -> Column:
    """Round function: the low bits of the MD5 of turn, seed and half."""
    turn = F.lit(turn) if isinstance(turn, int) else turn
    said = F.concat_ws(":", turn.cast("string"), seed.cast("string"), half.cast("string"))
    return digest_number(said).bitwiseAND(F.lit((1 << bits) - 1))


def domain_halves(identifier: Column | str, kind: str) -> tuple[Column, Column]:
    """Upper and lower half of an identifier's number. Whole numbers are themselves; a text is its 120 bits of MD5."""
    c = col(identifier)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        n = c.cast("long")
        return F.shiftrightunsigned(n, HALF), n.bitwiseAND(F.lit((1 << HALF) - 1))
    return digest_number(c.cast("string")), digest_number(c.cast("string"), 15, 16)


def permuted(number: Column, seed: Column | int, bits: int, rounds: int = ROUNDS) -> Column:
    """Balanced Feistel network over 2**bits numbers, bits even: for every seed a bijection, computed without state."""
    half, mask = bits // 2, (1 << (bits // 2)) - 1
    seed = F.lit(seed) if isinstance(seed, int) else seed
    start = F.struct(F.shiftrightunsigned(number, half).bitwiseAND(F.lit(mask)).alias("l"), number.bitwiseAND(F.lit(mask)).alias("r"))
    turn = lambda s, r: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_turned(s["r"], seed, r, half)).alias("r"))
    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), start, turn, lambda s: F.shiftleft(s["l"], half).bitwiseOR(s["r"]))


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """64-bit finalizer with a key, on unsigned arrays."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute_range(index: np.ndarray, size: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Permutation of 0 .. size-1 at the given indexes, by walking the cycles of a network over the next power of four."""
    half = max(1, (max(2, size) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    x = np.asarray(index, dtype=np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(rounds):
            left, right = right, left ^ (_mix(right, seed * 1_000_003 + r * 7_919 + 1) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo &= x >= np.uint64(size)
    return x.astype(np.int64)


def stable_sample(rows: DataFrame, identifier: str, rate: float, seed: int | str) -> DataFrame:
    """Rows whose identifier's permuted number lies under rate × domain size.

    Whether a row is taken depends on its identifier and the seed alone: reruns, partitionings, row order and added
    rows change nothing, and a larger rate keeps all rows of a smaller one. `seed` is a number or a column. The network
    is a bijection of 2**120 numbers, so different numbers never collide; whole-number identifiers are such numbers, texts
    become them by their MD5 (at 10**12 texts the odds that any two meet are about 10**-12). One map over the rows, no shuffle.

    Defined results: rows with null identifier or seed are never taken; repeated rows share their fate; rates
    outside 0..1 are refused; an empty table gives an empty sample; extra columns may have any name.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in 0..1")
    up, low = domain_halves(F.col(f"`{identifier}`"), dict(rows.dtypes)[identifier])
    s = F.col(f"`{seed}`") if isinstance(seed, str) else F.lit(seed)
    names = rows.columns
    d = rows.withColumns({_UP: up, _LOW: low, _SEED: s}).where(F.col(_UP).isNotNull() & F.col(_SEED).isNotNull())
    for turn in range(ROUNDS):  # a step a column, so no round is written out twice
        d = d.withColumn("_jm_new", F.col(_UP).bitwiseXOR(_turned(F.col(_LOW), F.col(_SEED), turn, HALF)))
        d = d.select(*[f"`{c}`" for c in names], _SEED, F.col(_LOW).alias(_UP), F.col("_jm_new").alias(_LOW))
    under = int(rate * (1 << 2 * HALF))
    first, rest = under >> HALF, under & ((1 << HALF) - 1)
    taken = (F.col(_UP) < first) | ((F.col(_UP) == first) & (F.col(_LOW) < rest))
    return d.where(taken).select(*[f"`{c}`" for c in names])


def broken_promises(entries: DataFrame, versions: DataFrame, held: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """(seed, choice_index, crop_id) of entries that a later version of the same seed did not keep.

    entries: seed, choice_index, crop_id, split, frozen_at; versions: seed, choice_index of all frozen lists. An entry
    that was in a held split at choice_index - 1 must have the same split at choice_index if that version exists. Rows
    are first reduced to one a version of an entry, which pre-aggregates copies; an entry's versions then meet, however large
    the seed. Nothing is drawn here: which choice was broken is a fact of the table, whoever drew it.

    Defined results: of rows of one entry that disagree, the one frozen last holds, of equally late ones the split last
    in the alphabet. Rows with a null seed, index, identifier or split say nothing. Empty tables give an empty result.
    """
    said = entries.where("seed is not null and choice_index is not null and crop_id is not null and split is not null")
    one = said.groupBy("seed", "crop_id", "choice_index").agg(F.max(F.struct("frozen_at", "split")).alias("last"))
    of_entry = Window.partitionBy("seed", "crop_id").orderBy("choice_index")
    after = F.lead(F.struct(F.col("choice_index").alias("i"), F.col("last.split").alias("s"))).over(of_entry)
    was = one.withColumn("after", after).where(F.col("last.split").isin(list(held)))
    due = (F.col("choice_index") + 1).alias("choice_index")
    kept = F.coalesce((F.col("after.i") == F.col("choice_index") + 1) & (F.col("after.s") == F.col("last.split")), F.lit(False))
    lost = was.where(~kept).select("seed", due, "crop_id")
    there = versions.select("seed", "choice_index").distinct()
    return lost.join(there, ["seed", "choice_index"], "left_semi").select("seed", "choice_index", "crop_id")
