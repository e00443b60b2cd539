"""A corpus pipeline: quality, exact copies, near copies, packing. Each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next stage's ``docs``. The first
three return the columns of ``documents``, the last the packed pieces. SQL can't express the classifier, the encoder or
the packing, so ``ORACLE_SQL`` is None and tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import exact, neardup, packing, quality
from kindred.llm.common import drop, materialize, read

SEQUENCE, END = 2048, 0


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold, learned from the labels that aren't held out.

    Null and empty texts are scored like any other, as one passage without words; repeated rows are scored alike; an empty
    table gives an empty one. Other columns pass through, whatever their names."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id.

    A null text counts as empty, and of all empty ones one stays. Of rows with equal ids and texts one stays. A null id stays
    only where its group has no other. An empty table gives an empty one; other columns pass through."""
    return exact.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 over five-word shingles join, that with the smallest id.

    Null and empty texts are linked with nothing and stay. Rows of one id stay or go together; those with a null id stay. An
    empty table gives an empty one; other columns pass through."""
    gone = neardup.near_duplicates(docs, words=5, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"))
    # Ids that go: fewer and narrower rows than the documents, which are dealt out once.
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, each with its sequence and place.

    A null or empty text is the end token alone; a long one is cut into full pieces; repeated rows are packed as often as
    they occur; an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, END)


STAGES = [("quality", keep_quality), ("exact", drop_copies), ("near", drop_near_copies), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
