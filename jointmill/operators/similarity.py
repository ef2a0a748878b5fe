"""Pairs of similar photos within a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointmill.functions.scores import hamming_words, print_words, word_digits
from jointmill.operators.joins import many_to_many, skew_safe_lookup
from jointmill.session import written


def _parts(digits: int, n: int) -> list[tuple[int, int]]:
    """digits cut into n runs of nearly equal length: (start from 1, length)."""
    edges = [round(i * digits / n) for i in range(n + 1)]
    return [(a + 1, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def embedded(rows: DataFrame, keep: list[str], payload: list[str], feature: Callable[[pd.DataFrame], list[list[float]]], batch: int = 16, name: str = "vector") -> DataFrame:
    """rows' `keep` columns with the vector that an injected function makes of the payload, asked for `batch` rows at a time.

    The function goes to the workers with the plan; a row for which it gives None has a null vector.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = [v for i in range(0, len(b), batch) for v in feature(b[payload].iloc[i : i + batch])]
            yield b[keep].assign(**{name: pd.Series([None if v is None else [float(x) for x in v] for v in vectors], index=b.index, dtype=object)})

    return rows.select(*dict.fromkeys([*keep, *payload])).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{name}` array<double>")


#: Candidate pairs of one shared part that are compared without cutting further, and how often parts are cut.
PART_PAIRS, LEVELS = 1_000_000, 3


def print_class(block: list[str], w: str = "w") -> Column:
    """128-bit key of a fingerprint in its block; unlike fingerprints of 10**12 share one with odds of about 10**-15."""
    return F.struct(F.xxhash64(*block, w).alias("a"), F.xxhash64(F.lit("again"), *block, w).alias("b"))


def near_classes(left: DataFrame, right: DataFrame, limit: int, digits: int = 64, once: bool = False, part_pairs: int = PART_PAIRS) -> DataFrame:
    """(ida, idb, distance): fingerprints of left and right that lie in one block and within `limit` bits.

    left and right hold different (id, block, w): print_class(), a hash of the block, and print_words(); `once` keeps
    ida < idb only. Fingerprints within the limit agree in one of limit + 1 parts, so those that share a part are compared.
    A part that too many share, such as a dark corner, is cut further: of the digits outside it, limit + 1 parts are
    taken again, one of which must agree too. After LEVELS cuts the pairs of a part that is still hot are made by many
    tasks. No pair is lost.
    """
    if limit + 1 > digits // 4:
        raise ValueError("parts below four digits bring nearly everything together")

    def cut(rows: DataFrame, key: Column, rest: Column, length: int) -> tuple[DataFrame, int]:
        parts = _parts(length, limit + 1)
        left_over = length - max(n for _, n in parts)
        others = lambda at, n: F.substring(F.concat(F.substring(rest, 1, at - 1), F.substring(rest, at + n, length)), 1, left_over)
        keys = F.array(*[F.struct(F.xxhash64(key, F.lit(i), F.substring(rest, at, n)).alias("key"), others(at, n).alias("rest")) for i, (at, n) in enumerate(parts)])
        return rows.withColumn("_k", F.explode(keys)).select("id", "w", F.col("_k.key").alias("key"), F.col("_k.rest").alias("rest")), left_over

    def near(pairs: DataFrame) -> DataFrame:
        if once:
            pairs = pairs.where("ida < idb")
        return pairs.withColumn("distance", hamming_words(F.col("wa"), F.col("wb"), digits)).where(F.col("distance") <= limit).select("ida", "idb", "distance")

    named = lambda rows: [d.select("key", F.col("id").alias(f"id{n}"), F.col("w").alias(f"w{n}")) for d, n in zip(rows, "ab", strict=True)]
    cuts = [cut(d, F.col("block"), word_digits(F.col("w"), digits), digits) for d in (left, right)]
    found: list[DataFrame] = []
    for level in range(LEVELS):
        sides, length = [d for d, _ in cuts], cuts[0][1]
        keyed = sides[0].select("key", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(sides[1].select("key", F.lit(0).alias("l"), F.lit(1).alias("r")))
        hot = keyed.groupBy("key").agg(F.sum("l").alias("_l"), F.sum("r").alias("_r")).where(F.col("_l").cast("double") * F.col("_r") > part_pairs)
        slim = named(sides)
        if hot.isEmpty():
            found.append(near(slim[0].join(slim[1], "key")))
            break
        hot = written(hot, "hot-parts")
        cold = [d.join(hot.select("key"), "key", "left_anti") for d in slim]
        found.append(near(cold[0].join(cold[1], "key")))
        total = hot.agg(F.sum("_l"), F.sum("_r")).first()
        warm = [written(skew_safe_lookup(d, hot.select("key", n), "key", n, t), "hot-rows") for d, n, t in zip(sides, ("_l", "_r"), total, strict=True)]
        if level == LEVELS - 1:
            found.append(near(many_to_many(*named(warm), ["key"])))
        else:
            cuts = [cut(d, F.col("key"), F.col("rest"), length) for d in warm]
    return reduce(DataFrame.unionByName, found).distinct()


def _tiled(rows: DataFrame, block: list[str], key: Column, tile: int, compare: Callable[[pd.DataFrame, bool], pd.DataFrame], schema: str) -> DataFrame:
    """compare() of every two tiles of every block, and of every tile with itself.

    Blocks are cut by the key into tiles of about `tile` rows, so each call has at most two of them however large the block.
    compare() gets the rows of both, with `_own` saying of which tile, and whether they are one tile.
    """
    tiles = rows.groupBy(*block).agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    k = rows.join(tiles, block).withColumn("_own", F.pmod(F.xxhash64(key), "_tiles").cast("int"))
    k = k.withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).drop("_tiles")
    k = k.withColumns({"_t": F.least("_own", "_u"), "_u": F.greatest("_own", "_u")})
    return k.groupBy(*block, "_t", "_u").applyInPandas(lambda p: compare(p, bool(p["_t"].iloc[0] == p["_u"].iloc[0])), schema)


def _words(p: pd.DataFrame) -> np.ndarray:
    return np.stack([p[c].to_numpy(np.int64) for c in p.columns if c.startswith("w")], axis=1).view(np.uint64)


def _sides(p: pd.DataFrame, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows to compare with each other: all with all of one tile, or one tile with the other."""
    if alone:
        return np.arange(len(p)), np.arange(len(p))
    own = p["_own"].to_numpy() == p["_t"].to_numpy()
    return np.flatnonzero(own), np.flatnonzero(~own)


def hamming_pairs(rows: DataFrame, block: list[str], item: str, fingerprint: str, limit: int, digits: int = 64, tile: int = 1024) -> DataFrame:
    """(item_a, item_b, distance), a < b, of one block whose fingerprints differ in at most `limit` bits.

    Different fingerprints are compared as classes, and their items joined to the classes afterwards. As long as
    limit + 1 parts keep four digits or more, by near_classes(); beyond that an index prunes nothing, and all classes of a
    block are compared, in tiles that are tasks of equal size however large the block. Null fingerprints and items match nothing.
    """
    r = rows.select(*block, F.col(item).alias("_item"), F.col(fingerprint).alias("_print")).na.drop()
    r, names = written(r.select(*block, "_item", print_words("_print", digits).alias("w")), "prints"), block
    cls = r.groupBy(*block, "w").agg(F.min("_item").alias("_first"))
    if limit + 1 <= digits // 4:
        kinds = written(r.select(print_class(block).alias("id"), F.xxhash64(*block).alias("block"), "w").groupBy("id", "block").agg(F.first("w").alias("w")), "classes")
        near, key, ends = written(near_classes(kinds, kinds, limit, digits, once=True), "near"), "id", ("ida", "idb")
        r, cls, block = r.withColumn("id", print_class(block)), kinds, []
    else:
        kind = dict(cls.dtypes)["_first"]

        def close(p: pd.DataFrame, alone: bool) -> pd.DataFrame:
            w, (i, j) = _words(p), _sides(p, alone)
            first = p["_first"].to_numpy()
            left, right, far = [], [], []
            for at, x in enumerate(i):
                rest = j[at + 1 :] if alone else j
                d = np.bitwise_count(w[rest] ^ w[x]).sum(axis=1, dtype=np.int32)
                hit = np.flatnonzero(d <= limit)
                left.append(np.full(len(hit), x)), right.append(rest[hit]), far.append(d[hit])
            a, b, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, far))
            return pd.DataFrame({"fa": first[a], "fb": first[b], "distance": d.astype(np.int32), **{f"b{n}": p[c].iloc[0] for n, c in enumerate(block)}})

        kinds = ", ".join(f"b{n} {dict(cls.dtypes)[c]}" for n, c in enumerate(block))
        flat = cls.select(*block, "_first", "w.*")
        # written, as the planner would take the pairs for as few as the fingerprints
        near = written(_tiled(flat, block, F.col("w0"), tile, close, f"fa {kind}, fb {kind}, distance int, {kinds}"), "near")
        near, key, ends = near.withColumnsRenamed({f"b{n}": c for n, c in enumerate(block)}), "_first", ("fa", "fb")
        r = r.join(cls, [*block, "w"])
    same = cls.select(*block, *[F.col(key).alias(e) for e in ends], F.lit(0).alias("distance"))
    a, b = (r.select(*(names if x == "x" else block), F.col("_item").alias(x), F.col(key).alias(e)) for x, e in zip(("x", "y"), ends, strict=True))
    found = many_to_many(near.select(*block, *ends, "distance").unionByName(same).join(a, [*block, ends[0]]), b, [*block, ends[1]])
    found = found.where((F.col(ends[0]) != F.col(ends[1])) | (F.col("x") < F.col("y")))
    return found.select(*names, F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "distance")


def spanning_edges(words: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """(a, b, distance) of a minimum spanning forest of the rows of words, by Prim's method, over distances up to limit."""
    k, out = len(words), []
    best, near, left = np.full(k, np.iinfo(np.int32).max, np.int32), np.zeros(k, np.int64), np.ones(k, bool)
    now = 0
    for _ in range(k - 1):
        left[now] = False
        d = np.bitwise_count(words ^ words[now]).sum(axis=1, dtype=np.int32)
        closer = left & (d < best)
        best[closer], near[closer] = d[closer], now
        now = int(np.argmin(np.where(left, best, np.iinfo(np.int32).max)))
        if best[now] <= limit:
            out.append((int(near[now]), now, int(best[now])))
    return out


def hamming_forest(rows: DataFrame, block: list[str], item: str, fingerprint: str, limit: int, digits: int = 64, tile: int = 2048) -> DataFrame:
    """(item_a, item_b, distance): edges that give, at every threshold up to `limit`, the components of all hamming_pairs.

    Every two distinct fingerprints of a block are compared, but only a minimum spanning forest is kept: an edge that is
    largest on a cycle joins nothing at any threshold. Blocks are cut into tiles of about `tile` fingerprints and every
    two tiles give a forest of their own; their union holds the block's forest, so no task holds a block. Equal fingerprints
    are compared once, their items linked to the smallest of them at distance 0. Null items, blocks and fingerprints match nothing.
    """
    r = rows.select(*block, F.col(item).alias("_item"), F.col(fingerprint).alias("_print")).na.drop()
    r = r.select(*block, "_item", print_words("_print", digits).alias("w"))
    cls = r.groupBy(*block, "w").agg(F.min("_item").alias("_first"))
    kind = dict(cls.dtypes)["_first"]

    def forest(p: pd.DataFrame, alone: bool) -> pd.DataFrame:
        # two tiles hold the edges within either, so a tile alone is only asked where its block has no other
        found = np.zeros((0, 3), np.int64) if alone and p["_many"].iloc[0] else np.array(spanning_edges(_words(p), limit), np.int64).reshape(-1, 3)
        first = p["_first"].to_numpy()
        return pd.DataFrame({"item_a": first[found[:, 0]], "item_b": first[found[:, 1]], "distance": found[:, 2].astype(np.int32)})

    many = cls.groupBy(*block).agg((F.count("*") > tile).alias("_many"))
    flat = cls.join(many, block).select(*block, "_first", "_many", "w.*")
    near = _tiled(flat, block, F.col("w0"), tile, forest, f"item_a {kind}, item_b {kind}, distance int")
    same = r.join(cls, [*block, "w"]).where("_item <> _first").select(F.col("_first").alias("item_a"), F.col("_item").alias("item_b"), F.lit(0).alias("distance"))
    return near.unionByName(same)


def cosine_pairs(rows: DataFrame, block: list[str], item: str, vector: str, least: float, tile: int = 1024) -> DataFrame:
    """(block..., item_a, item_b, similarity), a < b, of one block whose cosine is at least `least`.

    Norms are floored at 1e-12. All vectors of a block are compared, by matrix products of tiles that are tasks of equal
    size however large the block; vectors of a block must be of one length. Null vectors, items and blocks match nothing.
    """
    r = rows.select(*block, F.col(item).alias("_item"), F.col(vector).alias("_v")).na.drop()
    kinds = dict(r.dtypes)

    def close(p: pd.DataFrame, alone: bool) -> pd.DataFrame:
        v = np.array(p["_v"].tolist(), np.float64)
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
        i, j = _sides(p, alone)
        s = v[i] @ v[j].T
        a, b = np.nonzero(s >= least)
        if alone:
            a, b = a[a < b], b[a < b]
        items = p["_item"].to_numpy()
        return pd.DataFrame({"x": items[i[a]], "y": items[j[b]], "similarity": s[a, b], **{f"b{n}": p[c].iloc[0] for n, c in enumerate(block)}})

    schema = f"x {kinds['_item']}, y {kinds['_item']}, similarity double, " + ", ".join(f"b{n} {kinds[c]}" for n, c in enumerate(block))
    found = _tiled(r, block, F.col("_item"), tile, close, schema).where("x <> y")
    return found.select(*[F.col(f"b{n}").alias(c) for n, c in enumerate(block)], F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "similarity")
