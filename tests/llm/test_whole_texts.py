"""Mixes and pieces on documents and spans that were once left out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jointmill.llm import mixture, pieces, queries


def test_mix_of_null_and_repeated_documents(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["solder", "joint", "spike", "ok"]) for _ in range(rng.randrange(5, 90)))
    data = [(None, text(), "a") for _ in range(20)] + [(1, text(), "a")] * 2 + [(i % 3, text(), "a") for i in range(20)] + [(None, text(), "nulls") for _ in range(9)]
    data += [(1, text(), "b"), (7, None, "a"), (8, text(), None), (None, None, None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    tokens = mixture.by_source(docs, True)
    want = {s: sorted(r["ids"] for r in tokens.where(F.col("source") == s).collect() if r["n"]) for s in ("a", "b", "nulls")}
    blocks = mixture.packed(tokens, 40, block=32, chunk=10).orderBy("source", "block").collect()
    for s, texts in want.items():
        own = [r for r in blocks if r["source"] == s]
        assert [r["block"] for r in own] == list(range(len(own))) and all(len(r["ids"]) == 32 for r in own[:-1])
        assert sorted(x for r in own for x in r["ids"]) == sorted(x for t in texts for x in t)
    mix = spark.createDataFrame([(1, "a", 50, 9, 900), (1, "nulls", 50, 9, 900)], "mix_id bigint, source string, weight_pct int, max_repeats int, budget_tokens bigint")
    out = mixture.mixed(mix, docs, block=32).groupBy("source").agg(F.sum(F.size("ids")).alias("n"), F.count("*").alias("k")).collect()
    said = {r["source"]: (r["actual_tokens"], r["filled"]) for r in mixture.report(mix, docs, block=32).collect()}
    assert {r["source"]: (r["n"], r["k"]) for r in out} == said


def test_shortages_come_from_the_packed_and_drawn_mix(spark, monkeypatch, tmp_path):
    """p8_found counts what is in the blocks and puts them into the slots: a block that packing loses makes its source short."""
    data = [(i, "solder joint ok " * (5 + i % 7), "a" if i % 2 else "B ") for i in range(80)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    have = {r["source"]: r["n"] for r in mixture.by_source(docs, False).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    # a: exactly enough; b: one token less than wanted; none: no documents
    rows = [(1, " A", 100, 3, 3 * have["a"]), (2, "b", 100, 2, 2 * have["b"] + 1), (3, "none", 100, 2, 0), (4, "none", 50, 2, 40), (4, None, 50, 2, 40)]
    mix = spark.createDataFrame(rows, "mix_id bigint, source string, weight_pct int, max_repeats int, budget_tokens bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    mix.write.parquet(f"{tmp_path}/mixture.parquet")
    found = lambda: {tuple(r) for r in queries.p8_found(spark, str(tmp_path)).collect()}
    assert found() == {(2, "b"), (4, "none"), (4, None)}
    said = {(r["mix_id"], r["source"]): r for r in queries.p8_report(spark, str(tmp_path)).collect()}
    out = {(r["mix_id"], r["source"]): r["n"] for r in queries.p8_mix(spark, str(tmp_path)).groupBy("mix_id", "source").agg(F.sum(F.size("ids")).alias("n")).collect()}
    assert out == {k: r["actual_tokens"] for k, r in said.items() if r["actual_tokens"]} and all(r["actual_tokens"] < r["target_tokens"] for r in said.values() if r["short"])
    whole, drawn = mixture.packed, []
    plan = mixture.plan
    monkeypatch.setattr(mixture, "packed", lambda *a, **k: whole(*a, **k).where("source != 'a' or block > 0"))
    monkeypatch.setattr(mixture, "plan", lambda *a, **k: drawn.append(a) or plan(*a, **k))
    assert found() == {(1, " A"), (2, "b"), (4, "none"), (4, None)} and len(drawn) == 1


def test_cuts_take_boundaries_outside_the_middle_half():
    some = lambda *places: (np.array(places, np.int64), np.full(len(places), 2, np.int64))
    cuts = lambda total, limit, *places: pieces.bisected(total, limit, *some(*places), np.arange(1, total + 1))
    assert cuts(240, 224, 40) == [(0, 6), (40, 2)] and cuts(240, 224, 200) == [(0, 6), (200, 2)]
    assert cuts(240, 224, 20, 40, 239) == [(0, 6), (40, 2)]
    assert cuts(240, 224, 5) == [(0, 6), (5, 2), (122, 0)]  # neither part of a cut at 5 is left uncut between words
    assert cuts(240, 224) == [(0, 6), (120, 0)] and cuts(224, 224, 40) == [(0, 6)]


@pytest.mark.parametrize("between", ["\u3000", "\u00a0", "\u2028", "\u2009\u2009", ".", ",", "...", "؟"])
def test_weak_boundaries(between):
    raw = f"solder{between}joint".encode()
    at, how = pieces.boundaries(raw)
    inside = between if between[0] in ".,؟" else ""
    assert (at.tolist(), how.tolist()) == ([len(f"solder{inside}".encode())], [1])
    assert [pieces.NAMES[k] for k in pieces.boundaries(f"a b.c{between}d. e".encode())[1]][0] == "word"
