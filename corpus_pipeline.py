"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, pieces. Each stage's result is written and read again.

Stages work on whole rows: repeated rows are rows of their own unless said otherwise, further columns pass through all but
the last stage whatever their names, and an empty table gives an empty one with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from public_tokenizers import path

from trellis.llm import mixing, pieces, secrets, similar, toxicity
from trellis.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier rejects go. A null text scores as the empty one; a null doc_id has no label."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, near duplicates: one document of each group stays, that with the smallest doc_id, a null one last, ties by a
    hash of the row. Repeated rows are near duplicates of each other. Null texts and texts without words all stay."""
    return similar.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every span found is replaced by a mark, overlapping ones by one. Null texts stay null; no row goes."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents as often as the mix takes them, the last one of a source cut to its budget. A null source is one
    of its own; documents without words, null ones too, stay once. Ties of the order go by doc_id, then by a hash of the text."""
    return mixing.apply_mix(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sampled piece ids of each document, their checksum, and whether they decode to the text. A null text is
    the empty one; rows alike in doc_id and text give the same pieces."""
    return pieces.digested(docs, path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("near duplicates", keep_one_of_each), ("secrets", redact_secrets), ("mixing", mix), ("pieces", sample_pieces)]

#: A learned classifier and sampled segmentations aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
