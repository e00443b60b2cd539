"""One query an operator, over its whole table, in the columns that its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import bpe, chat, exact, licenses, neardup, packing, quality, sql, token_counts, topk, urls
from kindred.llm.common import read

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), *token_counts.sentencepiece_vocabulary(PIECES))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), RULES)


def op5_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(read(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), WORDS, 2048, 0)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_trees(chat.tree_of_turns(turns))
    return chat.read_back(done.withColumnRenamed("tree_id", "conv_id"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), WORDS)


QUERIES = {f.__name__: f for f in (op1_tokens, op2_topk, op3_quality, op4_urls, op5_minmax, op6_licenses, op7_exact, op8_pack, op9_chat, op10_bpe)}
ORACLE = {"op2_topk": sql.TOPK, "op4_urls": sql.link_trust(RULES), "op5_minmax": sql.NEAR, "op6_licenses": sql.license_windows(licenses.TEMPLATES), "op7_exact": sql.EXACT, "op9_chat": sql.CHAT}
