"""A training corpus from raw documents: five stages, each over all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairtract.llm import bpe, mixing, near, passages, quality, storage

VOCABULARY = "word_bpe_49k.json"


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with bands fitted on all labelled good ones."""
    bands = quality.fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.is_kept(F.col("text"), bands))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on five-word shingles of similarity 0.8.

    Rows of one doc_id are one document, of which the first text stays; rows
    without a doc_id stay.
    """
    judged = near.near_duplicates(docs, shingle=5, percent=80)
    dropped = storage.stage(judged.where("not kept").select("doc_id").distinct(), "dropped")
    repeated = storage.stage(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    single = docs.join(dropped.union(repeated), "doc_id", "left_anti")
    several = docs.join(repeated, "doc_id", "left_semi").join(dropped, "doc_id", "left_anti")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    # The helper column gets a name that no column of the documents has.
    place = "_" * (1 + max(map(len, docs.columns)))
    several = several.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(*columns).unionByName(several.select(*columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those with repeated passages without them; ``n_chars`` follows the text."""
    cut = passages.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))

    def column(name: str):
        if name == "doc_id":
            return F.col("doc_id")
        if name == "text":
            return text.alias("text")
        old = F.col("rest")[name]
        if name == "n_chars":
            old = F.when(changed, F.length("kept_text")).otherwise(old).cast(docs.schema[name].dataType)
        return old.alias(name)

    return cut.select(*map(column, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.drawn(mixing.mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the text that they decode to."""
    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("source mix", mix_sources),
    ("byte-pair encoding", encode),
]

#: SQL has no zstandard; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again.

    Only the table that the last stage reads is left there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        with storage.scope(spark):
            docs = storage.stage(function(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        if before is not None:
            storage.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
