"""The corpus pipeline: documents in, packed training sequences out, through operators of jobloom.llm.

Each stage works on all rows that the one before it kept. All but the last return documents with the
columns they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import mixing, near_dedup, packing, pii, quality
from jobloom.llm.scratch import clear, standing, table, written
from jobloom.llm.tokenizing import word_bpe_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels in sf_dir."""
    net = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    # columns of the classifier's own names stand aside meanwhile
    aside = {c: f"{c} of the documents" for c in ("score", "predicted")}
    scored = quality.classify(docs.withColumnsRenamed(aside), net).where("predicted = 1").drop("score", "predicted")
    return scored.withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, one with the smallest doc_id; a row without doc_id only if none has any.

    Shingles have five words here, as all near-duplicate stages do; op2's contract alone asks for four.
    Rows are known by numbers of their own, as doc_id may be repeated or missing.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), whole), "near-dedup-rows")
    found = near_dedup.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    found = found.select(F.col("doc_id").alias("row"), "component_id")
    known = rows.select("row", F.col("doc.doc_id").alias("doc_id")).join(found, "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    kept = known.groupBy("component_id").agg(first).select(F.col("first.row").alias("row"))
    # the narrow side is hashed, so that documents need no sort
    return rows.join(kept.hint("shuffle_hash"), "row", "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data and secrets."""
    # a column of the operator's own name stands aside meanwhile
    aside = {"n_entities": "n_entities of the documents"}
    out = pii.replace_entities(docs.withColumnsRenamed(aside), pii.key_of(spark)).drop("n_entities")
    out = out.withColumnsRenamed({v: k for k, v in aside.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of their sources' targets: a row for each pass that takes words of one."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    return packing.pack_documents(docs, word_bpe_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("near-dedup", near_duplicate_filter),
    ("pii", pii_surrogates),
    ("source mixing", source_mix),
    ("best-fit packing", packed_sequences),
]

#: SQL cannot express a trained network, nor keyed draws; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over all documents in sf_dir, each stage's rows written and read again.

    A stage's own tables go as soon as its rows are written. Those of the last stand until the caller has read its
    rows and calls scratch.clear().
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before = list(standing(spark))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
            clear(spark, before, docs)
    return docs
