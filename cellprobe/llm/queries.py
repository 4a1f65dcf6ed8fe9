"""Queries of the training-data operators, one per operator, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession

from cellprobe.llm.bpe import bpe_digest
from cellprobe.llm.io import table
from cellprobe.llm.media import copy_classes, page_images
from cellprobe.llm.substrings import remove_repeats
from cellprobe.llm.lines import line_digest
from cellprobe.llm import topk, urls
from cellprobe.llm.simhash import simhash_groups
from cellprobe.llm.secrets import scan
from cellprobe.llm.packing import pack
from cellprobe.llm.langid import predict, train

WORD_BPE = "word_bpe_49k.json"


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_classes(page_images(table(spark, sf_dir, "pages")), id_col="page_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op3_urls": op3_urls,
    "op9_topk": op9_topk,
    "op4_lines": op4_lines,
    "op5_substrings": op5_substrings,
    "op2_media": op2_media,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {
    "op3_urls": urls.ORACLE,
    "op9_topk": topk.ORACLE,
}
