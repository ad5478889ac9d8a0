"""URL rules by a sort-merge range join over reversed-host keys, with native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairtract.llm.storage import stage

#: Ends the host in a key; no host or path sorts between a host's end and its paths.
HOST_END = "\x01"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Reversed host labels, the host's end, then the path; as hex, which sorts like the bytes."""
    host = F.array_join(F.reverse(labels), ".")
    return F.hex(F.encode(F.concat(host, F.lit(HOST_END), path), "UTF-8"))


def rule_segments(rules: DataFrame) -> DataFrame:
    """``host, path, verdict`` rules to disjoint key ranges: ``key`` where one begins, ``rule, verdict`` in it.

    A rule covers the keys that begin with its own, an interval; intervals are
    nested or apart. A sorted sweep over their ends keeps the stack of open
    rules: after each end the depth of the stack is a running sum, and the rule
    on top is the last one that opened at that depth. Equal rules count once;
    of equal rules with different verdicts ``block`` holds. Rules are a
    configuration table, swept in one task.
    """
    path = F.coalesce("path", F.lit(""))
    host = F.coalesce("host", F.lit(""))
    named = (
        rules.select(
            _key(F.split(host, r"\."), path).alias("key"),
            F.concat(host, path).alias("rule"),
            F.col("verdict"),
        )
        .groupBy("key", "rule")
        .agg(F.max("verdict").alias("verdict"))
    )
    found = F.struct("rule", "verdict")
    # "G" sorts after every hex digit: just past all keys with the rule's prefix.
    ends = named.select(
        F.explode(
            F.array(
                F.struct(F.col("key").alias("key"), F.lit(1).alias("step"), found.alias("open")),
                F.struct(F.concat("key", F.lit("G")).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("open")),
            )
        ).alias("e")
    ).select("e.*")
    # At one key, inner rules close before outer ones, and all before others open.
    swept = Window.orderBy("key", "step").rowsBetween(Window.unboundedPreceding, 0)
    at_depth = Window.partitionBy("depth").orderBy("key", "step").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ends.withColumn("depth", F.sum("step").over(swept))
        .withColumn("top", F.when(F.col("depth") > 0, F.last("open", ignorenulls=True).over(at_depth)))
        .groupBy("key")
        # Of several ends at one key the last one leaves the deepest or the final stack.
        .agg(F.max_by("top", F.struct("step", F.when(F.col("step") > 0, F.col("depth")).otherwise(-F.col("depth")))).alias("top"))
        .select("key", F.coalesce("top.rule", F.lit("")).alias("rule"), F.col("top.verdict").alias("verdict"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The longest rule that fits each url of ``pages(page_id, url)``.

    A rule fits its host and all subdomains if the path begins with the rule's
    path. Each url therefore has one key per suffix of its host, and a key lies
    in the interval of exactly those rules of that suffix that fit. Distinct
    keys and the segments of the rules are sorted together by range; each key
    takes the segment that began last, and a range begins with the one carried
    over from the ranges before it. Equal urls are looked up once, so a very
    common url or host is no hot key.

    Returns one row per input row: ``page_id, url, host, path, rule, verdict``.
    Null urls and those without ``://`` have an empty host and path, fit no rule
    and get the default, as all without a rule do. Longest is by characters of
    host and path together; equal lengths go to the longer host. Repeated rows
    stay; no other column is read.
    """
    urls = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    distinct = urls.where(F.col("host") != "").groupBy("host", "path").agg(F.lit(1).alias("one"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.slice(labels, i, F.size(labels) - i + 1))
    probes = (
        distinct.select("host", "path", F.explode(suffixes).alias("labels"))
        .select("host", "path", F.size("labels").alias("n_labels"), _key(F.col("labels"), F.col("path")).alias("key"))
    )
    segments = rule_segments(rules)
    probe_type = "struct<host:string,path:string,n_labels:int>"
    begin_type = "struct<rule:string,verdict:string>"
    both = (
        probes.select("key", F.struct("host", "path", "n_labels").cast(probe_type).alias("probe"), F.lit(None).cast(begin_type).alias("begin"))
        .unionByName(segments.select("key", F.lit(None).cast(probe_type).alias("probe"), F.struct("rule", "verdict").cast(begin_type).alias("begin")))
    )
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the ranges must be the same when they are read for the carry and for the sweep.
    ranged = stage(both.repartitionByRange(partitions, "key").withColumn("range", F.spark_partition_id()), "url-ranges")
    last = ranged.where("begin is not null").groupBy("range").agg(F.max_by("begin", "key").alias("begin"))
    ranges = ranged.select("range").distinct().join(last, "range", "left")
    carried = ranges.select(
        "range",
        F.last("begin", ignorenulls=True)
        .over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        .alias("carry"),
    )
    sweep = Window.partitionBy("range").orderBy("key", F.col("begin").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    matched = (
        ranged.withColumn("begin", F.last("begin", ignorenulls=True).over(sweep))
        .where("probe is not null")
        .join(carried, "range")
        .select("probe.*", F.coalesce("begin", "carry").alias("fit"))
        .where(F.col("fit.rule") != "")
    )
    longest = matched.groupBy("host", "path").agg(
        F.max_by("fit", F.struct(F.length("fit.rule"), F.col("n_labels"))).alias("fit")
    )
    return urls.join(longest, ["host", "path"], "left").select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.lit(default)).alias("verdict"),
    )


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` rules as a table."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "host string, path string, verdict string")
