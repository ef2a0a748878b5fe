"""Every query of the training-data problems, beside its SQL where there is one, on the small test tables."""

import os

import pytest

from jointmill.llm import oracle, queries
from verify import compare, duck

DATA = os.environ.get("JOINTMILL_TESTDATA", "/root/testdata")
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    d = f"{DATA}/sf0.001"
    said = compare(spark, duck(d), name, queries.queries()[name], oracle.oracle_sql().get(name), d)
    assert said.startswith(("ok", "rows")), said


def test_found_texts(spark):
    """p8 and p9 against a plain count of every text's tokens."""
    from jointmill.llm.tokens import encoder, vocabulary_path

    d = f"{DATA}/sf0.001"
    own = encoder(vocabulary_path())
    docs = [(r["doc_id"], own.core.encode_ordinary(r["text"] or ""), r["kind"], (r["source"] or "").strip().lower()) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    most = {r["kind"]: r["max_tokens"] for r in spark.read.parquet(f"{d}/piece_limits.parquet").collect()}
    assert {r["doc_id"] for r in queries.p9_found(spark, d).collect()} == {i for i, t, k, _ in docs if len(t) > most[k]}
    have = {}
    for _, t, _, s in docs:
        have[s] = have.get(s, 0) + len(t)
    mix = spark.read.parquet(f"{d}/mixture.parquet").collect()
    want = {(r["mix_id"], r["source"]) for r in mix if have.get(r["source"].strip().lower(), 0) * r["max_repeats"] * 100 < r["weight_pct"] * r["budget_tokens"]}
    assert {tuple(r) for r in queries.p8_found(spark, d).collect()} == want
    assert {r["doc_id"]: r["ids"] for r in queries.p7_ids(spark, d).collect()} == {i: t for i, t, _, _ in docs}
