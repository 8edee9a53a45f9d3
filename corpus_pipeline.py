"""The corpus pipeline: documents to packed training sequences.

Toxic documents go, one document of each group of near duplicates stays, personal data
is masked, sources are mixed to their targets (a document may then occur twice), and
what is left is packed. Each stage takes and, but for the last, returns the columns of
documents; run() writes every stage's result to the shared folder and reads it back.
Stages with Python workers bound the session's Arrow batches by rows and bytes, as a row
is a whole text; run() gives the session its own bounds back.

Every stage takes documents with nulls in any column, empty and very long texts, ties,
repeated rows and further columns (all but the last give these back as they came), and
gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import mixing, packing, pii, resemblance, simhash, toxicity
from claimloom.llm._common import batches, discard, small_batches, table, write_shared


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; null and empty texts are scored like others, repeated rows go or stay together."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash components, and copies of which four fifths stand in shared five-word shingles, which two bits miss.

    Texts without words, null ones too, are copies of each other; documents without an id are told apart by their texts.
    """
    small_batches(spark)
    return simhash.simhash_dedup(docs, also=resemblance.resemblance_links)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; null texts stay null, every row stays."""
    small_batches(spark)
    return pii.mask_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, none to two times; a null source is a source, ties go by a hash of the id."""
    # the document rides along whole: its columns may have the names of the mix's own
    rows = docs.select("doc_id", "source", mixing.document_size().alias("n_words"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    return mixing.apply_mix(mixing.mix_sources(rows, sized="n_words"), ["document"]).select("document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens, a row a piece; an empty or null text is its end mark, a document that occurs twice is packed twice."""
    small_batches(spark)
    # executors still hold what earlier stages left them; a smaller cache costs some time
    return packing.pack_documents(docs, packing.default_tokenizer(), cache=20_000, rows=100)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("pii", mask_private), ("mixing", mix), ("packing", pack)]

#: No SQL has a boosted-tree score, a SimHash, a semi-Markov field or a tokenizer; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    with batches(spark):
        for _, stage in STAGES[:-1]:
            path = write_shared(stage(spark, docs, sf_dir))
            if before:
                discard(spark, before)
            docs, before = spark.read.parquet(path), path
        packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, before)  # what packing gives back rests on its own checkpoints
    return packed
