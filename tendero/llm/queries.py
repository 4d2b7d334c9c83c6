"""The operators applied to whole tables, with the parameters they run with in production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendero.llm.decontaminate import benchmark_overlaps
from tendero.llm.embedding import near_vectors
from tendero.llm.line_dedup import cut_lines
from tendero.llm.masked_lm import pseudo_likelihood
from tendero.llm.merkle import leaf_of, manifest
from tendero.llm.ngram_join import ngram_components
from tendero.llm.oracle import ORACLE
from tendero.llm.packing import pack, word_lengths
from tendero.llm.prefix_trie import prefix_trie, turn_lists
from tendero.llm.substring import cut_repeats
from tendero.llm.token_files import read_tokens, write_tokens
from tendero.llm.toxicity import fit, scored
from tendero.llm.url_filter import judge, tracked
from tendero.llm.warc import read_archive, write_archive, write_index

__all__ = ["ORACLE", "QUERIES"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(_table(spark, folder, "documents"), size=3, percent=90)


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = cut_repeats(_table(spark, folder, "documents").select("doc_id", "text"), window=35)
    return cut.select("rest.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def warc(spark: SparkSession, folder: str) -> DataFrame:
    directory = write_index(write_archive(_table(spark, folder, "pages"), least_bytes=0))
    return read_archive(directory).drop("url")


#: The rules of the contract as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return judge(pages, RULES, tracked(pages)).drop("canonical")


def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return scored(docs, fit(docs, _table(spark, folder, "labels"))).drop("row")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return read_tokens(write_tokens(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"), threshold=0.95)


def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(word_lengths(_table(spark, folder, "documents"))).drop("row")


def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_likelihood(_table(spark, folder, "documents"))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversation c of the contract: up to h = crc32(c) % 9 first turns of c - c % 5, then its own from the h-th on."""
    lists = turn_lists(conversations)
    starts = lists.where("conv_id % 5 = 0").select(F.col("conv_id").alias("start"), F.slice("turns", 1, 8).alias("shared"))
    h = F.expr("cast(crc32(cast(cast(conv_id as string) as binary)) % 9 as int)")
    joined = lists.join(starts, F.expr("conv_id - conv_id % 5") == F.col("start"), "left").withColumn("h", h)
    shared = F.coalesce(F.expr("slice(shared, 1, h)"), F.expr("slice(turns, 1, 0)"))
    return joined.select("conv_id", F.concat(shared, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(rebuilt(_table(spark, folder, "conversations")))


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = cut_lines(_table(spark, folder, "documents").select("doc_id", "text"), least_docs=5, least_chars=40)
    return cut.select("rest.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Fixed value: one id in so many, by CRC, is claimed with a character more than it has.
TAMPERED = 7


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = leaf_of([F.col(c) for c in fields])
    more = leaf_of([F.col(c) if c != "n_chars" else F.col(c).cast("decimal(38,0)") + 1 for c in fields])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return manifest(docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf.alias("leaf"), F.when(chosen, more).alias("claimed")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join,
    "op2_warc_capture_index": warc,
    "op3_substring_dedup": substring_dedup,
    "op4_embedding_near_dedup": embedding_dedup,
    "op5_url_filter": url_filter,
    "op6_toxicity": toxicity,
    "op7_token_files": token_files,
    "op8_best_fit_packing": packing,
    "op9_benchmark_decontamination": decontamination,
    "op10_lm_scoring": lm_scoring,
    "op11_conversation_prefix_trie": conversation_trie,
    "op12_line_dedup": line_dedup,
    "op13_merkle_manifest": merkle_manifest,
}
