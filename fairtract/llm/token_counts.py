"""Token totals by source, language and tokenizer version, kept up to date by signed deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
#: Marks a batch as committed; the mark of Spark's own committer may be switched off.
MARK = "_COMMITTED"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counted(docs: DataFrame, tokenizer: str, n_tokens: Column, sign: int = 1) -> DataFrame:
    """One signed row per document of ``docs(source, lang, ...)``; a null count is 0."""
    return docs.select(
        F.col("source"),
        F.col("lang"),
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("long").alias("n_docs"),
        (F.lit(sign) * F.coalesce(n_tokens, F.lit(0)).cast("long")).alias("n_tokens"),
    )


def inserted(docs: DataFrame, tokenizer: str, n_tokens: Column) -> DataFrame:
    return counted(docs, tokenizer, n_tokens)


def deleted(docs: DataFrame, tokenizer: str, n_tokens: Column) -> DataFrame:
    """Takes out documents with the counts under which they stand in the totals."""
    return counted(docs, tokenizer, n_tokens, -1)


def revised(docs: DataFrame, tokenizer: str, old: Column, new: Column) -> DataFrame:
    """Replaces counts: the old ones are taken out, the new ones go in; no join is needed."""
    change = F.coalesce(new, F.lit(0)).cast("long") - F.coalesce(old, F.lit(0)).cast("long")
    return counted(docs, tokenizer, change).withColumn("n_docs", F.lit(0).cast("long"))


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def commit(spark: SparkSession, path: str, batch: str, deltas: DataFrame) -> bool:
    """Add a batch to the totals below ``path``, once.

    Deltas are added up in each task before the shuffle, so a source with most
    of the rows is no hot key, and written as one small table in a folder of
    the batch. The folder counts once this function's mark is there: a batch that
    broke off is written anew, one that is committed is left as it is. Returns
    whether anything was written.
    """
    folder = f"{path}/batch={batch}"
    if _exists(spark, f"{folder}/{MARK}"):
        return False
    sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sums.coalesce(1).write.mode("overwrite").parquet(folder)
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MARK}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, False).close()
    return True


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``source, lang, tokenizer, n_docs, n_tokens`` over all committed batches.

    Null sources and languages are groups of their own. Groups of which nothing
    is left are not returned. No batch, or batches of empty tables, give no
    rows.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [s.getPath().toString() for s in system.listStatus(root)] if system.exists(root) else []
    done = [f for f in folders if _exists(spark, f"{f}/{MARK}")]
    rows = spark.read.schema(DELTAS).parquet(*done) if done else spark.createDataFrame([], DELTAS)
    sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")


def copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs(doc_id, text, ...)`` whose text a smaller doc_id has; a null text is an empty one.

    Rows of one doc_id and rows without one are no copies. All columns are returned, whatever their names.
    """
    # Helper columns get names longer than any of the documents.
    mark = "_" * max(map(len, docs.columns))
    digest, first, times = f"{mark}digest", f"{mark}first", f"{mark}times"
    keyed = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    firsts = keyed.groupBy(digest).agg(F.min("doc_id").alias(first), F.count("*").alias(times)).where(F.col(times) > 1)
    return keyed.join(firsts, digest).where(F.col("doc_id") > F.col(first)).select(*[F.col(f"`{c}`") for c in docs.columns])


def both(*deltas: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, deltas)
