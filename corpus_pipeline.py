"""From raw documents to token ids: five stages, each over everything that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontamination, line_dedup, minhash_dedup, quality
from strandloom.llm.text import free_name
from strandloom.session import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under the threshold go."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")  # labels refer to these
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = free_name("__score", docs.columns)
    scored = quality.score(docs, labels, sample_of=documents, to=name)
    return scored.filter(F.col(name) >= quality.KEEP).select(*docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, except from one document."""
    out = line_dedup.dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id."""
    groups = minhash_dedup.near_groups(docs, minhash_dedup.Plan())
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontamination.contained_items(docs, items).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids (little-endian unsigned 32-bit), their number, and whether they decode to the text."""
    text = F.coalesce("text", F.lit(""))
    cols = docs.select("doc_id", "lang", "source", text.alias("text"), F.sha2(text, 256).alias("__sha256"))
    out = bpe.round_trip(cols, "text", "ids", "decoded", public_tokenizers.path(bpe.VOCAB))
    return out.select(
        "doc_id", "lang", "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.sha2("decoded", 256) == F.col("__sha256")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", lines_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: SQL can't express the first stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
