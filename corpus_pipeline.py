"""The corpus pipeline: toxicity, quality, line deduplication, near-duplicates, packing.

Every stage takes any table with doc_id and text, decides row by row and returns the rows it keeps with all their
columns as they were, but for the texts and lengths that drop_lines rewrites: rows with a null doc_id, rows that repeat
an id or a whole row, null, empty and very long texts are judged each by itself, and extra columns come through
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaspan.llm import line_dedup, packing, quality, simhash, toxicity
from chromaspan.llm.common import stored


def _carried(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator uses, and all but the text in one column of structs."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("carried")
    return docs.select(*(c for c in ("doc_id", "text", *used) if c in docs.columns), rest)


def _columns(docs: DataFrame) -> list:
    """The columns of docs of a result with its text and what was carried."""
    return [F.col("text") if c == "text" else F.col(f"carried.`{c}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text isn't predicted to be toxic; a null or empty text isn't."""
    scores = toxicity.score(_carried(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["text", "carried"])
    return scores.filter("predicted = 0").select(*_columns(docs))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of good quality by their text and record (lang, source, n_chars); all, if no model can be fitted."""
    scores = quality.score(_carried(docs, "lang", "source", "n_chars"), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["text", "carried"])
    return scores.filter("kept").select(*_columns(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without repeated lines (null: empty); n_chars, if there is one, follows."""
    out = line_dedup.dedup_lines(_carried(docs), keep=["carried"]).select(*_columns(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: one with the smallest doc_id, nulls last. Texts without words are one group."""
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens in sequences of at most 2048: a row per piece (see packing.pack)."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_duplicates), ("packing", pack)]

#: Learned scores, fingerprints and tokens have no SQL; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
