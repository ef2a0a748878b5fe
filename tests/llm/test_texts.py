import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jointmill.llm import mixture, pieces, tokens

OWN = tokens.encoder(tokens.vocabulary_path())
ODD = [None, "", " ", "\n\n \t", "don't'say  it's", "<|endoftext|>", "漢字かな交じり文。" * 40, "-" * 5000, "a" * 3000 + " " * 50 + "b", "à la  mode", "\x1c\x85\xa0 x", "��Ã©", "¿qué?'são 😀😀" * 30, "1234567890" * 20]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text):
    assert OWN.encode(text).tolist() == (OWN.core.encode_ordinary(text) if text else [])
    assert OWN.count(text) == len(OWN.encode(text))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abst'dlrevm  \n\t.,!?-019éñß漢字のは。、　\xa0"), st.characters(exclude_categories=("Cs",))), max_size=300))
def test_ids_of_any_text(text):
    assert OWN.encode(text).tolist() == OWN.core.encode_ordinary(text)


def test_cuts_are_certain():
    """No token of the vocabulary holds the pair of bytes at a cut."""
    raw = ("漢字かな交じり文。、！" * 20).encode()
    at = OWN.cuts(raw)
    assert len(at) > 10 and not any(OWN.joined[raw[i - 1], raw[i]] for i in at)


def test_pairs_that_only_the_pattern_cuts():
    """The few cut pairs that tokens hold: there the scanner's cut is the end of a word, and ids stay those of the whole text."""
    assert 0 < len(OWN.held) < 60
    for x, y in OWN.held:
        for space in (c for c in map(chr, range(0x3001)) if c.encode()[0] == y and tokens.re.match(f"[{tokens.SPACE}]", c)):
            before = [chr(x)] if x < 128 else [c for c in map(chr, range(0xA1, 0x800)) if c.encode()[-1] == x][:40]
            for text in (f"{a}{space}b {a}{a}{space}{space}{a}" for a in before):
                assert OWN.encode(text).tolist() == OWN.core.encode_ordinary(text)


def test_unknown_vocabulary(spark, tmp_path):
    import base64

    own = "".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)) + f"{base64.b64encode(b'a b').decode()} 256\n" + f"{base64.b64encode(b'a ').decode()} 257\n"
    (tmp_path / "v.tiktoken").write_text(own)
    with pytest.raises(ValueError, match="pattern"):
        tokens.encoder(str(tmp_path / "v.tiktoken"))
    df = spark.createDataFrame([("a b",)], "text string")
    got = tokens.encoded(df, path=str(tmp_path / "v.tiktoken"), pattern=r"(?s:.+)").first()["ids"]
    assert got == [256]  # this pattern has words across white space, so nothing is cut


def test_encoded_table(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id bigint, text string, ids string")
    with_names = tokens.encoded(df.withColumnRenamed("ids", "n"), count="k")
    got = {r["doc_id"]: r for r in with_names.collect()}
    assert len(got) == len(ODD) and got[0]["ids"] == [] and got[0]["k"] == 0 and got[0]["n"] == "x"
    assert all(got[i]["ids"] == OWN.encode(t).tolist() for i, t in enumerate(ODD))
    assert tokens.encoded(df.drop("ids").limit(0)).count() == 0


def test_clashing_names_and_damaged_bytes(spark):
    df = spark.sql("select 1L as doc_id, cast(unhex('ff6162') as string) as text, 'old' as ids, 2 as n, 'a' as kind, 3 as piece, 'b' as boundary")
    r = tokens.encoded(df, count="n").first()
    assert r["ids"] == OWN.encode("\ufffdab").tolist() and r["n"] == len(r["ids"]) and r["piece"] == 3
    limits = spark.createDataFrame([("a", 1, 0, 7)], "kind string, max_tokens int, overlap_tokens int, doc_id int")
    assert pieces.pieces(df, limits).count() == len(r["ids"])


def check_pieces(text, most, overlap):
    found = pieces.pieces_of(text, OWN, most, overlap)
    n = OWN.count(text)
    assert found[0][0] == 0 and found[-1][1] == n
    assert all(b - a <= most for a, b, *_ in found)
    assert all(b[0] == a[1] - min(overlap, most - 1) or b[0] == 0 for a, b in zip(found, found[1:], strict=False))
    assert all(a[1] < b[1] for a, b in zip(found, found[1:], strict=False))
    raw = (text or "").encode()
    for a in found:
        raw[a[2] : a[3]].decode("utf-8")  # whole characters
    return found


@pytest.mark.parametrize("text", ODD)
@pytest.mark.parametrize("most,overlap", [(16, 4), (16, 0), (64, 63), (8, 20)])
def test_pieces_of_odd_texts(text, most, overlap):
    check_pieces(text, most, overlap)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n漢。、!?\té😀", max_size=400), st.integers(4, 40), st.integers(0, 10))
def test_pieces_of_any_text(text, most, overlap):
    check_pieces(text, most, overlap)


def test_natural_cuts():
    text = "\n\n".join(" ".join(f"word{i} and more" for i in range(12)) + "." for _ in range(12))
    found = check_pieces(text, 160, 16)
    assert len(found) > 3 and {f[4] for f in found} == {"paragraph"}
    assert {f[4] for f in check_pieces("one two three. four five six. " * 80, 60, 5)[1:]} == {"sentence"}


def test_pieces_table(spark, rows):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "word " * 100, "a"), (4, "word " * 100, None), (5, "word " * 100, "other"), (6, "word", "a")], "doc_id bigint, text string, kind string")
    limits = spark.createDataFrame([("a", 30, 5), ("a", 40, 5), (None, 1, 0)], "kind string, max_tokens int, overlap_tokens int")
    p = pieces.pieces(df, limits)
    n = {r["doc_id"]: r["n"] for r in p.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n[3] > 3 and [n[i] for i in (1, 2, 4, 5, 6)] == [1] * 5
    assert p.where("n_tokens > 30 and doc_id = 3").count() == 0
    assert rows(p.where("doc_id < 3"), "doc_id", "n_tokens", "text") == [(1, 0, None), (2, 0, "")]
    assert pieces.pieces(df.limit(0), limits).count() == 0


DOCS = "doc_id bigint, text string, source string"
MIX = "mix_id bigint, source string, weight_pct int, max_repeats int, budget_tokens bigint"


def docs(spark):
    rng = random.Random(2)
    texts = lambda k: " ".join(rng.choice(["solder", "joint", "spike", "ok"]) for _ in range(k))
    rows = [(i, texts(rng.randrange(1, 400)), rng.choice(["Big ", "big", "BIG"])) for i in range(300)] + [(1000 + i, texts(50), "small") for i in range(5)]
    return spark.createDataFrame([*rows, (2000, None, "big"), (2001, "", "small"), (2002, "lost", None)], DOCS)


def test_draws_are_exact():
    for wanted in ([10, 20, 70], [0, 0, 5], [1000, 1, 0], []):
        out = list(mixture.draw_shards(sum(wanted), wanted, (1,)))
        assert [sum(c[i] for _, c, _ in out) for i in range(len(wanted))] == wanted
        assert all(sum(c) == mixture.SHARD for _, c, _ in out[:-1])
        for a in range(0, len(out), 5):  # a shard's draw needs no other shard's
            part = list(mixture.draw_shards(sum(wanted), wanted, (1,), a, a + 3))
            assert [(s, c.tolist(), b.tolist()) for s, c, b in part] == [(s, c.tolist(), b.tolist()) for s, c, b in out[a : a + 3]]


def test_shards_of_a_huge_mix():
    wanted = [3 * 10**12, 10**12, 7]
    n = -(-sum(wanted) // mixture.SHARD)
    (shard, counts, before), *_ = mixture.draw_shards(sum(wanted), wanted, (5,), n // 3, n // 3 + 1)
    assert shard == n // 3 and sum(counts) == mixture.SHARD and abs(before[0] / wanted[0] - 1 / 3) < 1e-5


def test_hypergeometric_beyond_numpy():
    """The sampler for totals that numpy refuses follows the same law."""
    rng = np.random.default_rng(3)
    own = [mixture.hypergeometric(rng, 300, 700, 200, least=0) for _ in range(4000)]
    mean, var = 60, 200 * 0.3 * 0.7 * 800 / 999
    assert abs(np.mean(own) - mean) < 5 * (var / 4000) ** 0.5 and abs(np.var(own) / var - 1) < 0.15
    assert min(own) >= 0 and [mixture.hypergeometric(rng, 5, 0, 3, least=0), mixture.hypergeometric(rng, 0, 5, 3, least=0)] == [3, 0]


def test_blocks_hold_every_token_once(spark):
    d = docs(spark)
    t = mixture.by_source(d, True)
    blocks = mixture.packed(t, 300, block=64, chunk=20)
    want = {r["source"]: r["s"] for r in t.groupBy("source").agg(F.sum("n").alias("s")).collect()}
    got = blocks.groupBy("source").agg(F.sum(F.size("ids")).alias("s"), F.count("*").alias("b"), F.max("block").alias("m"), F.sum((F.size("ids") < 64).cast("int")).alias("short"))
    for r in got.collect():
        assert r["s"] == want[r["source"]] and r["b"] == r["m"] + 1 == -(-want[r["source"]] // 64) and r["short"] <= 1
    flat = {r["source"]: [] for r in got.collect()}
    for r in blocks.orderBy("source", "block").collect():
        flat[r["source"]] += r["ids"]
    text = {r["doc_id"]: r["ids"] for r in t.where("source = 'small' and n > 0").collect()}
    stream, left = flat["small"], dict(text)
    while stream:  # the stream is the documents one after the other
        k = next(k for k, v in left.items() if stream[: len(v)] == v)
        stream = stream[len(left.pop(k)) :]
    assert not left


def test_report_and_mix(spark):
    m = spark.createDataFrame([(1, "big", 70, 2, 20000), (1, "Small", 20, 3, 20000), (1, "none", 10, 4, 20000), (2, " BIG", 100, 9, 5000), (3, None, 100, None, None)], MIX)
    r = {(x["mix_id"], x["source"]): x for x in mixture.report(m, docs(spark), block=64).collect()}
    assert not r[1, "big"]["short"] and r[1, "Small"]["short"] and r[1, "none"]["short"] and not r[2, " BIG"]["short"] and not r[3, None]["short"]
    assert abs(r[1, "big"]["actual_tokens"] - 14000) <= 128 and abs(r[2, " BIG"]["actual_pct"] - 100) < 1e-9
    assert r[1, "Small"]["actual_tokens"] == 3 * r[1, "Small"]["available_tokens"] and r[1, "none"]["actual_tokens"] == 0
    out = mixture.mixed(m, docs(spark), block=64)
    sums = {(x["mix_id"], x["source"]): x["s"] for x in out.groupBy("mix_id", "source").agg(F.sum(F.size("ids")).alias("s")).collect()}
    assert sums == {k: x["actual_tokens"] for k, x in r.items() if x["actual_tokens"]}
    used = out.groupBy("mix_id", "source", "block").agg(F.count("*").alias("k"), F.count_distinct("repeat").alias("d"))
    assert used.where("k <> d or (source = 'Small' and k > 3) or (mix_id = 1 and source = 'big' and k > 2)").count() == 0
    assert out.groupBy("mix_id", "shard", "slot").count().where("count > 1").count() == 0


def test_mix_of_nothing(spark):
    m = spark.createDataFrame([(1, "big", 100, 2, 1000)], MIX)
    assert mixture.report(m, docs(spark).limit(0)).first()["short"]
    assert mixture.report(m.limit(0), docs(spark)).count() == 0
    assert mixture.mixed(m, docs(spark).limit(0)).count() == 0
