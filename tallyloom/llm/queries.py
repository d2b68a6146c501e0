"""The driver's queries opN_<name> over whole tables, each through its operator."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, counts, embeddings, fingerprints, id_files, language, minhash, packing, pieces, repeats
from .common import local_rows
from .oracles import ORACLE_SQL  # noqa: F401  handed on by the entry


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2, length=4096)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = embeddings.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return linked.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"), width=100)
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    decided = language.identify_languages(docs, language.fit_text_model(docs))
    return decided.select("doc_id", "language", "text_language", "confidence", "n_trigrams", (~F.col("rejected")).alias("kept"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on raw pages: declared markup language, address suffix and host."""
    model = language.fit_text_model(table(spark, sf_dir, "documents"))
    pages = language.page_evidence(table(spark, sf_dir, "pages"))
    decided = language.identify_languages(pages, model, declared_col="declared", host_col="host", suffix_col="suffix")
    return decided.select("page_id", "host", "suffix", "declared", "language", "text_language", "confidence", (~F.col("rejected")).alias("kept"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = fingerprints.compare_with_next(table(spark, sf_dir, "documents"))
    return compared.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counts.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = id_files.new_path(spark)
    id_files.write_ids(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", end_id=2)
    return id_files.document_checksums(id_files.read_pieces(spark, path)).withColumnRenamed("id", "doc_id")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = local_rows(spark, {"conv_id": (pa.int64(), [-7, -7]), "turn": (pa.int64(), [0, 1]), "role": (pa.string(), ["user", "assistant"]), "text": (pa.string(), [said, said])})
    digests = chat.conversation_digests(chat.format_conversations(rows.unionByName(extra)))
    return digests.withColumnRenamed("conv", "conv_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_pieces(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    both = pieces.decode_pieces(encoded, "piece_bpe_32k.model")
    return both.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_packing, op2_embedding_near_dedup, op3_suffix_dedup, op4_language_id, op5_fingerprints, op6_token_counts, op7_id_files, op8_minhash_near_dedup, op9_chat_formatting, op10_sentencepiece, language_id_pages)}

