"""Evaluation of retrieval: accuracies, rates, percentiles, comparison of two rankings, and deterministic corpora for timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.operators.feedback import recall_and_mrr


def accuracy(results: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row (n, right, missing, accuracy): how many expected rows have a result of the same value."""
    got = results.select(*keys, F.col(value).alias("_got"), F.lit(True).alias("_there"))
    met = expected.select(*keys, F.col(value).alias("_want")).join(got, keys, "left")
    right = F.col("_there").isNotNull() & F.col("_got").eqNullSafe(F.col("_want"))
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"), F.count_if(F.col("_there").isNull()).alias("missing"), F.round(F.avg(F.when(right, 1.0).otherwise(0.0)), 6).alias("accuracy"))


def window_rate(results: DataFrame, wanted: DataFrame, k: int = 3) -> DataFrame:
    """One row (n, rate): the share of wanted byte ranges (query_id, document_id, start, end) that one of a query's first k windows (query_id, rank, document_id, start_byte,
    end_byte) contains whole."""
    near = results.where(F.col("rank") <= k).join(wanted, ["query_id", "document_id"]).where("start_byte <= start AND end_byte >= end").select("query_id").distinct().withColumn("hit", F.lit(1.0))
    return wanted.select("query_id").distinct().join(near, "query_id", "left").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("rate"))


def hint_violations(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """One row (n, false_snippets, missed, over_budget) of decisions (message_id, outcome, tokens) against expected (message_id, outcome, budget)."""
    met = expected.select("message_id", F.col("outcome").alias("want"), "budget").join(decisions, "message_id", "left")
    return met.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("outcome") == "historical-snippet") & (F.col("want") != "historical-snippet")).alias("false_snippets"),
        F.count_if((F.coalesce("outcome", F.lit("suppress")) == "suppress") & (F.col("want") != "suppress")).alias("missed"), F.count_if(F.col("tokens") > F.col("budget")).alias("over_budget"),
    )


def nearest_rank(values: DataFrame, column: str, by: list[str], shares: list[float]) -> DataFrame:
    """Percentiles by nearest rank: the value at place ceil(share * n)."""
    return values.groupBy(*by).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(f"p{round(100 * p)}") for p in shares], F.count(F.lit(1)).alias("n"))


def compared_rankings(base: DataFrame, other: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """One row with recall and reciprocal rank of two rankings and whether the other one is to be taken: better in one and worse in neither."""
    a = recall_and_mrr(base, relevant, k).select("n_queries", F.col("recall_at_k").alias("recall_base"), F.col("mrr").alias("mrr_base"))
    b = recall_and_mrr(other, relevant, k).select(F.col("recall_at_k").alias("recall_other"), F.col("mrr").alias("mrr_other"))
    better = (F.col("recall_other") >= F.col("recall_base")) & (F.col("mrr_other") >= F.col("mrr_base")) & ((F.col("recall_other") > F.col("recall_base")) | (F.col("mrr_other") > F.col("mrr_base")))
    return a.join(b).withColumn("take", better)


def documents_for_timing(spark: SparkSession, n: int) -> DataFrame:
    """(document_id, project, session_id, kind, created_at, text): n made-up documents; the text has 160 characters, each 1,000th 10 KiB, each 10,000th 1 MiB. Word w of
    document i is a hash of both, so any row can be made by itself."""
    size = F.when(F.col("id") % 10_000 == 9_999, 1 << 20).when(F.col("id") % 1_000 == 999, 10 << 10).otherwise(160)
    words = F.transform(F.sequence(F.lit(1), F.ceil(size / 7).cast("int")), lambda w: F.concat(F.lit("w"), F.lpad(F.conv(F.pmod(F.xxhash64("id", w), F.lit(50_000)).cast("string"), 10, 36), 6, "0")))
    text = F.expr("substring(array_join(words, ' '), 1, size)")
    made = spark.range(n).withColumn("size", size).withColumn("words", words)
    return made.select(F.col("id").alias("document_id"), F.lit("timing").alias("project"), F.concat(F.lit("s"), F.col("id") % 100).alias("session_id"), F.lit("turn").alias("kind"), (F.lit(1_700_000_000_000) + F.col("id") * 1_000).alias("created_at"), text.alias("text"))


def provenance(documents: DataFrame) -> DataFrame:
    """(document_id, version, provenance): what identifies a document and its content, as one struct."""
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    return documents.select("document_id", "version", F.struct("project", "session_id", "kind", "created_at", content.alias("content_hash"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("byte_length")).alias("provenance"))


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that one of two tables of one schema has more often, with side: missing or extra."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("extra")))


def allowed(found: DataFrame, allowlist: DataFrame, keys: list[str]) -> DataFrame:
    """Differences that an allowlist of keys doesn't name."""
    return found.join(allowlist.select(*keys).distinct(), keys, "left_anti")
