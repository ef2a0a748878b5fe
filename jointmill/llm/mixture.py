"""Mixing sources to target weights."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.paths import trimmed
from jointmill.llm.feistel import permute_range
from jointmill.llm.tokens import encoded
from jointmill.session import dropped, written

#: Tokens of a block, blocks of an output shard, and shards that one task draws at a time.
BLOCK, SHARD, TOGETHER = 512, 64, 64


def by_source(documents: DataFrame, ids: bool, path: str | None = None) -> DataFrame:
    """(doc_id, source in plain form, n tokens[, ids]) of documents that have a source."""
    d = documents.select("doc_id", F.lower(trimmed("source")).alias("source"), "text").where("source is not null")
    return encoded(d, "text", path, "ids" if ids else None, "n")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int, least: int = 10**9) -> int:
    """How many of `drawn` slots out of good + bad are good.

    numpy refuses totals from 10**9 on; those are drawn from the same law by a ratio of uniforms.
    """
    total, lo, hi = good + bad, max(0, drawn - bad), min(good, drawn)
    if lo == hi:
        return lo
    if total < least:
        return int(rng.hypergeometric(good, bad, drawn))
    share = good / total
    spread = math.sqrt(drawn * share * (1 - share) * (total - drawn) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    log = lambda k: -sum(map(math.lgamma, (k + 1, good - k + 1, drawn - k + 1, bad - drawn + k + 1)))
    top = log(min(hi, max(lo, (drawn + 1) * (good + 1) // (total + 2))))
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = drawn * share + 0.5 + width * (v - 0.5) / u
        if lo <= x < hi + 1 and 2 * math.log(u) <= log(math.floor(x)) - top:
            return math.floor(x)


def draw_shards(slots: int, wanted: list[int], key: tuple[int, ...], first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, its slots of each source, slots of each source before it) of shards first .. last - 1.

    The counts of all shards are multinomial draws, given that the mix holds exactly `wanted` slots a source. They
    come down a binary tree of shard ranges: a node's counts are dealt to its halves by a draw seeded with the node, so
    any shard is reached in as many draws as the tree is deep, from no other shard's, by any task.
    """
    shards = -(-slots // SHARD)
    last = shards if last is None else min(last, shards)
    todo = [(0, shards, np.array(wanted, np.int64), np.zeros(len(wanted), np.int64))] if slots else []
    while todo:
        lo, hi, counts, before = todo.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, counts, before
            continue
        mid = (lo + hi) // 2
        rng, open_, rest = np.random.default_rng([*key, lo, hi]), (mid - lo) * SHARD, int(counts.sum())
        left = np.zeros_like(counts)
        for i, n in enumerate(counts.tolist()):
            left[i] = hypergeometric(rng, n, rest - n, open_)
            open_, rest = open_ - int(left[i]), rest - n
        todo.append((mid, hi, counts - left, before + left))
        todo.append((lo, mid, left, before))


def largest_remainder(total: int, weights: list[float]) -> list[int]:
    """Whole parts of total by weight."""
    s = sum(weights)
    if not s or not total:
        return [0] * len(weights)
    ideal = [total * w / s for w in weights]
    out = [int(x) for x in ideal]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - ideal[i], i))[: total - sum(out)]:
        out[i] += 1
    return out


def entries_of(mixture: DataFrame, totals: DataFrame) -> DataFrame:
    """Entries of the mixture with the plain source, its available tokens, and whether they fall short of the share."""
    m = mixture.select("mix_id", "source", F.lower(trimmed("source")).alias("plain"), "weight_pct", "max_repeats", "budget_tokens")
    m = m.join(totals.select(F.col("source").alias("plain"), F.col("tokens").alias("available")), "plain", "left")
    m = m.withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    there = F.col("available").cast("decimal(20,0)") * F.coalesce(F.col("max_repeats"), F.lit(0)) * 100
    return m.withColumn("short", there < F.coalesce(F.col("weight_pct"), F.lit(0)).cast("decimal(10,0)") * F.coalesce(F.col("budget_tokens"), F.lit(0)))


def plan(mixture: DataFrame, totals: DataFrame, seed: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(entries of the mixture with what their source holds, slots: mix_id, shard, slot, source, plain, k, block, repeat).

    mixture is a table someone wrote by hand; its entries are read to the driver, with one total each, and go to the
    tasks with the function. Everything else is drawn by the executors, a range of shards a task: the sources' counts of a
    shard by draw_shards(), the order of its slots by a seed of its own. The k-th slot of a source takes block k, modulo the
    source's blocks, of a pseudorandom permutation that differs in every repeat; slots beyond max_repeats rounds stay
    empty (their block is null).
    """
    spark = mixture.sparkSession
    entries = entries_of(mixture, totals)
    rows = sorted((r.asDict() for r in entries.collect()), key=lambda r: (r["mix_id"] is None, r["mix_id"] or 0, r["source"] or ""))
    whole = lambda x: int(x) if x is not None else 0
    mixes, tasks = [], [0]
    for mix in dict.fromkeys(r["mix_id"] for r in rows):
        own = [r for r in rows if r["mix_id"] == mix]
        budget = max(whole(r["budget_tokens"]) for r in own)
        slots = -(-budget * sum(whole(r["weight_pct"]) for r in own) // (100 * block))
        wanted = largest_remainder(slots, [whole(r["weight_pct"]) for r in own])
        mixes.append((mix, sum(wanted), wanted, [(r["source"], r["plain"], -(-r["available"] // block), whole(r["max_repeats"])) for r in own]))
        tasks.append(tasks[-1] + -(-sum(wanted) // (SHARD * TOGETHER)))
    kind = dict(mixture.dtypes)["mix_id"]

    def slots_of(number: int) -> pd.DataFrame:
        at = int(np.searchsorted(tasks, number, "right")) - 1
        mix, slots, wanted, own = mixes[at]
        key, start = (seed, whole(mix)), (number - tasks[at]) * TOGETHER
        parts = []
        for shard, counts, before in draw_shards(slots, wanted, key, start, start + TOGETHER):
            i = np.repeat(np.arange(len(own)), counts)
            k = np.concatenate([np.arange(b, b + n) for b, n in zip(before.tolist(), counts.tolist(), strict=True)])
            order = np.random.default_rng([*key, shard]).permutation(len(i))
            parts.append((np.full(len(i), shard), np.arange(len(i)), i[order], k[order]))
        shard, slot, i, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        blocks, most = (np.array([o[j] for o in own], np.int64) for j in (2, 3))
        turn = np.where(blocks[i] > 0, k // np.maximum(blocks[i], 1), most[i])
        out = pd.DataFrame({"mix_id": pd.Series([mix] * len(i), dtype=object), "shard": shard, "slot": slot, "source": pd.Series([own[x][0] for x in i], dtype=object), "plain": pd.Series([own[x][1] for x in i], dtype=object), "k": k})
        out["block"], out["repeat"] = pd.array([pd.NA] * len(i), "Int64"), turn
        filled = pd.DataFrame({"i": i, "turn": turn})[(turn < most[i]) & (blocks[i] > 0)]
        for (x, t), at in filled.groupby(["i", "turn"]).groups.items():
            own_key = seed + 1_000_003 * whole(mix) + 7_919 * int(x) + 104_729 * int(t)
            out.loc[at, "block"] = permute_range(k[at] % blocks[x], int(blocks[x]), own_key)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number in b["id"]:
                yield slots_of(int(number))

    drawn = spark.range(tasks[-1]) if tasks[-1] else spark.range(0)
    placed = drawn.mapInPandas(run, f"mix_id {kind}, shard bigint, slot bigint, source string, plain string, k bigint, block bigint, repeat bigint")
    return entries, placed


def tokens_of(mixture: DataFrame, documents: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(tokens of the documents of the mixture's sources, tokens and documents of each source, documents of the largest one)."""
    names = mixture.select(F.lower(trimmed("source")).alias("source")).distinct()
    d = documents.join(F.broadcast(names.withColumnRenamed("source", "_s")), F.lower(trimmed("source")) == F.col("_s"), "left_semi")
    tokens = written(by_source(d, True, path), "tokens")
    sizes = written(tokens.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("documents")), "source-totals")
    return tokens, sizes, sizes.agg(F.max("documents")).first()[0] or 0


def report(mixture: DataFrame, documents: DataFrame, seed: int = 0, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """Every entry of mixture with target, available and actual tokens and shares of the mix that results.

    The mix is made as mixed() makes it: documents are packed, slots drawn and blocks joined to them by index. What is
    available is counted in the packed blocks, the actual tokens in those that the slots took; only the tokens themselves
    are left out of the last join. `short` marks sources that can't reach weight_pct of budget_tokens even when each
    document is used max_repeats times.

    Defined results: sources are compared whatever their case and surrounding blanks; documents without a source
    belong to none; a document without a doc_id, or with a repeated one, counts like any other; a source without
    documents, or null, has 0 tokens; null numbers count as 0. An empty mixture gives an empty report.
    """
    tokens, _, most = tokens_of(mixture, documents, path)
    sizes = written(packed(tokens, most, seed, block).select("source", "block", F.size("ids").alias("n")), "block-sizes")
    dropped(tokens)
    totals = written(sizes.groupBy("source").agg(F.sum("n").alias("tokens")), "block-totals")
    entries, slots = plan(mixture, totals, seed, block)
    # slots are counted by block before the join, so the empty ones of a source are one row
    uses = slots.groupBy("mix_id", "source", "plain", "block").agg(F.count("*").alias("times"))
    taken = uses.hint("merge").join(sizes.withColumnRenamed("source", "plain"), ["plain", "block"], "left")
    filled = F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))
    drawn = taken.groupBy("mix_id", "source").agg(F.sum("times").alias("slots"), filled.alias("filled"), F.sum(F.col("times") * F.col("n")).alias("actual_tokens"))
    drawn = written(drawn, "drawn")  # a row an entry; the mix is made once, whatever columns are read
    dropped(sizes)
    same = F.col("u.mix_id").eqNullSafe(F.col("e.mix_id")) & F.col("u.source").eqNullSafe(F.col("e.source"))
    own = ["mix_id", "source", "weight_pct", "max_repeats", "budget_tokens", "available", "short"]
    wide = entries.select(*own).alias("e").join(drawn.alias("u"), same, "left")
    sums = wide.select(*[f"e.{c}" for c in own], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("slots", "filled", "actual_tokens")])
    z = lambda c: F.coalesce(F.col(c).cast("decimal(38,0)"), F.lit(0))
    whole = F.sum("actual_tokens").over(Window.partitionBy("mix_id"))
    return sums.select(
        "mix_id", "source", "weight_pct", "max_repeats", "budget_tokens", F.col("available").alias("available_tokens"), (z("weight_pct") * z("budget_tokens") / 100).cast("double").alias("target_tokens"),
        "slots", "filled", "actual_tokens", F.when(whole > 0, F.col("actual_tokens") * 100.0 / F.nullif(whole, F.lit(0))).otherwise(0.0).alias("actual_pct"), "short",
    )


def packed(tokens: DataFrame, documents: int, seed: int = 0, block: int = BLOCK, chunk: int = 20_000) -> DataFrame:
    """(source, block, ids): the documents of each source, in pseudorandom order, as one stream cut into equal blocks.

    The place of a document in its source's stream is a sum over chunks of about `chunk` documents and one within the
    chunk, so no task holds a source. The last block of a source is what remains.

    Defined results: every row is a document of its own. Rows that share a doc_id follow each other in the order of their
    tokens; rows without one are placed by their tokens. Rows equal in both are interchangeable, so the stream is the same
    in every run. Rows without tokens take no place; rows without a source are none of this table, see by_source().
    """
    chunks = max(1, -(-documents // chunk))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "ids")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    rows = tokens.where("n > 0").select("source", "doc_id", "n", "ids", key.alias("r"), F.shiftrightunsigned(key, 40).alias("c0")).withColumn("chunk", (F.col("c0") * chunks / (1 << 24)).cast("int"))
    sums = rows.groupBy("source", "chunk").agg(F.sum("n").alias("sum"))
    before = lambda *p: Window.partitionBy(*p).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "chunk", F.coalesce(F.sum("sum").over(before("source").orderBy("chunk")), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n").over(before("source", "chunk").orderBy("r", "doc_id", "ids")), F.lit(0))
    d = rows.withColumn("inner", inner).join(sums, ["source", "chunk"]).withColumn("start", F.col("base") + F.col("inner"))
    cut = d.select("source", "start", "n", "ids", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block))).alias("block"))
    first = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    upto = F.least(F.col("n"), (F.col("block") + 1) * block - F.col("start"))
    parts = cut.select("source", "block", F.struct((F.col("start") + first).alias("at"), F.slice("ids", (first + 1).cast("int"), (upto - first).cast("int")).alias("ids")).alias("part"))
    return parts.groupBy("source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))


def mixed(mixture: DataFrame, documents: DataFrame, seed: int = 0, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """(mix_id, shard, slot, source, block, repeat, ids) of every filled slot of every mix; see report() and packed() for the rules."""
    tokens, sizes, most = tokens_of(mixture, documents, path)
    _, slots = plan(mixture, sizes, seed, block)
    blocks = packed(tokens, most, seed, block).withColumnRenamed("source", "plain")
    # a merge, as the planner takes the slots for as few as the tasks that draw them
    return slots.where("block is not null").hint("merge").join(blocks, ["plain", "block"]).select("mix_id", "shard", "slot", "source", "block", "repeat", "ids")
