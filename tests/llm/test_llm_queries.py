"""The contracts' queries against DuckDB, and the pipeline against brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kindred.llm import queries, token_counts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cur = c.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, cur.fetchall()))


@pytest.fixture(scope="module")
def ids():
    """The library's ids of every document."""
    pdf = pd.read_parquet(f"{SF}/documents.parquet")
    tok = Tokenizer.from_file(queries.WORDS)
    tok.no_truncation()
    tok.no_padding()
    coded = tok.encode_batch([t or "" for t in pdf.text], add_special_tokens=False)
    return {i: (e.ids, tok.decode(e.ids, skip_special_tokens=False)) for i, e in zip(pdf.doc_id.tolist(), coded, strict=True)}


def test_bpe_query(spark, ids):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_bpe(spark, SF).collect()}
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, (x, t) in ids.items()}


def test_packing_query(spark, ids):
    got = queries.op8_pack(spark, SF).toPandas()
    expected = set()
    for i, (x, _) in ids.items():
        x = np.array([*x, 0], "<u4")
        expected |= {(i, k // 2048, k, len(x[k : k + 2048]), zlib.crc32(x[k : k + 2048].tobytes())) for k in range(0, len(x), 2048)}
    assert set(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == expected and len(got) == len(expected)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048
    # Within 1 % of the fewest sequences that the tokens alone need, and a sequence.
    assert got.sequence_id.nunique() <= 1.01 * got.length.sum() / 2048 + 1


def test_token_query(spark):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op1_tokens(spark, SF).collect()}
    pdf = pd.read_parquet(f"{SF}/documents.parquet")
    first, inner = token_counts.sentencepiece_vocabulary(queries.PIECES)
    a, f, i = token_counts.Automaton(first, inner), set(first), set(inner)
    known = {}
    for d, t in zip(pdf.doc_id.tolist(), pdf.text, strict=True):
        words = [w for c in (t or "").split() for w in a._splits(c)]
        assert got[d] == sum(known[w] if w in known else known.setdefault(w, token_counts.greedy(w, f, i) or 1) for w in words)
    assert len(got) == len(pdf)


def test_quality_query(spark):
    got = queries.op3_quality(spark, SF).toPandas()
    pdf = pd.read_parquet(f"{SF}/documents.parquet")
    assert sorted(got.doc_id) == sorted(pdf.doc_id) and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    own = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert ((own.predicted == own.quality)[own.held_out]).mean() > 0.9


@pytest.mark.parametrize("stage", range(4))
def test_stage_cases(spark, stage):
    """Nulls, empty and long texts, ties, repeated rows, an empty table; columns whose names clash with those in use."""
    from test_operators import TEXTS
    from test_operators import docs as made

    name, run = corpus_pipeline.STAGES[stage]
    d = made(spark).union(made(spark)).union(made(spark, ["same", "same", None, ""], 100))
    out = run(spark, d, SF)
    if name == "pack":
        assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and out.select("doc_id").distinct().count() == len(TEXTS) + 4
    else:
        assert out.schema.simpleString() == d.schema.simpleString() and 0 <= out.count() <= d.count()
    if name == "exact":
        assert sorted((r["text"] or "") for r in out.collect()) == sorted({t or "" for t in [*TEXTS, "same"]})
    assert run(spark, d.filter("false"), SF).count() == 0


def test_pipeline(spark):
    from test_operators import near_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.keep_quality(spark, docs, SF).cache()
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    single = corpus_pipeline.drop_copies(spark, good, SF).cache()
    rows = good.toPandas()
    assert set(single.toPandas().doc_id) == set(rows.groupby("text").doc_id.max())
    apart = corpus_pipeline.drop_near_copies(spark, single, SF).cache()
    by_hand = near_by_hand([(r["doc_id"], r["text"]) for r in single.collect()], 5)
    assert {r["doc_id"] for r in apart.collect()} == {i for i, (_, _, kept) in by_hand.items() if kept} and apart.columns == docs.columns
    packed = corpus_pipeline.pack(spark, apart, SF).toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in apart.collect()}
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.run(spark, SF).count() == len(packed)
