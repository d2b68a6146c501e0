"""Corpus preparation: language ID, near-dedup, repeated passages, packing.

All stages but the last return the columns of ``docs``, whatever they are called:
a row travels as one struct, so extra columns may have the operators' own names
(id, kept, language, ...).  Null texts count as empty ones; rows whose ids are null
or repeat are rows of their own; an empty table passes as an empty table; texts of
any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import language, minhash, packing, repeats
from tallyloom.llm.common import discard, few_files, materialize, numbered, scratch

#: No SQL: packing needs a tokenizer; run() is tested against brute force.
ORACLE_SQL = None


def _as_rows(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns, and whole rows as the struct ``_row``."""
    return docs.select(*[F.col(f"`{c}`") for c in named], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def _rows_back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a supported language; what is in none, or has no letters (null and empty texts too), goes.

    Repeated rows are decided alike; ties go to the language named first.
    """
    model = language.fit_text_model(docs)
    decided = language.identify_languages(_as_rows(docs, "doc_id", "text", "lang", "source"), model)
    return _rows_back(decided.where("not rejected"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five-word shingles, similarity 0.8).

    First by id, null before all, then by text; documents without words stay.
    """
    keyed = numbered(_as_rows(docs, "doc_id", "text"), "doc_id", "text", "_key")
    groups = minhash.near_duplicates(keyed, words=5, percent=80, id_col="_key")
    kept = groups.where("id = component_id").select(F.col("id").alias("_key"))
    return few_files(_rows_back(keyed.join(kept, "_key", "left_semi"), docs), docs.count())


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of 100 bytes and more that stand in an earlier one; characters cut in two go.

    Every document stays, a null text as the empty one; n_chars follows the new text.
    """
    cut = repeats.remove_repeats(docs, width=100, carry=tuple(docs.columns), decoded=True)
    kept = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    done = cut.select(*[(kept[c] if c in kept else F.col("carried").getField(c)).alias(c) for c in docs.columns])
    return few_files(done, docs.count())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 4096 ids, a row a piece of a document; a document without text is its end id."""
    packed = packing.pack_documents(docs, "word_bpe_49k.json", end_id=2, length=4096, table_size=150_000, keep_table=False)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [("language ID", identify), ("near-dedup", near_dedup), ("repeated passages", drop_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences; a stage's tables are deleted when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        with scratch(lambda: [docs]):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if before is not None:
            discard(before)
        before = docs
    return docs
