"""Exact postings: anchors of documents stored by value, looked up in an exact and then in a folded pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspan.functions import text as tx
from strataspan.operators.bm25f import bucket
from strataspan.operators.ranking import exact_score


def postings(anchors: DataFrame, most: int = 1_000) -> DataFrame:
    """(bucket, type, normalized, folded, document_id, version, specificity, n, start_byte): one row for each value of a document, with its first place and
    its number of places; a document's first most values, by place, are indexed, and partial says where that left some out."""
    one = anchors.groupBy("document_id", "version", "type", "normalized", "folded", "specificity").agg(F.count(F.lit(1)).alias("n"), F.min("start_byte").alias("start_byte"))
    w = Window.partitionBy("document_id", "version")
    ranked = one.withColumn("k", F.row_number().over(w.orderBy("start_byte", "type", "normalized"))).withColumn("partial", F.max("k").over(w) > most)
    return ranked.where(F.col("k") <= most).drop("k").withColumn("bucket", bucket(F.col("folded")))


def plan(spark: SparkSession, queries: list[tuple[int, str]]) -> DataFrame:
    """(query_id, type, normalized, folded, asked): the anchors that queries ask for, and how many each query has."""
    rows = [(q, kind, v, tx.normal_value(v, True), len(own)) for q, text in queries for own in [tx.planned(text)] for kind, v, _ in own]
    return spark.createDataFrame(rows, "query_id long, type string, normalized string, folded string, asked int")


def lookup(post: DataFrame, planned: DataFrame, retired: DataFrame | None = None, k: int = 100) -> DataFrame:
    """(query_id, rank, document_id, version, exact, matched, coverage, score): documents with the anchors of each query. Values match exactly, commits in either
    case; only a query without any exact match is asked again with folded values. Coverage is the share of the query's anchors that a document has."""
    live = post if retired is None else post.join(retired.select("document_id", "version").distinct(), ["document_id", "version"], "left_anti")
    slim = live.select("normalized", "folded", "type", "document_id", "version", "specificity")
    asked = F.broadcast(planned)
    same = (F.col("p.normalized") == F.col("q.normalized")) | ((F.col("q.type") == "commit") & (F.col("p.type") == "commit"))
    met = slim.alias("p").join(asked.alias("q"), F.col("p.folded") == F.col("q.folded")).select("q.query_id", "q.asked", F.col("q.folded").alias("anchor"), "p.document_id", "p.version", "p.specificity", same.alias("exact"))
    fine = met.join(met.groupBy("query_id").agg(F.max("exact").alias("has")), "query_id").where("exact OR NOT has")
    docs = fine.groupBy("query_id", "asked", "document_id", "version").agg(F.max("exact").alias("exact"), F.count_distinct("anchor").alias("matched"), F.max("specificity").alias("specificity"))
    scored = docs.withColumn("coverage", F.round(F.col("matched") / F.col("asked"), 6)).withColumn("score", exact_score(F.col("exact"), F.col("matched") / F.col("asked"), F.col("specificity")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("matched"), F.desc("version"), "document_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "document_id", "version", "exact", "matched", "coverage", "score")


def working_set_matches(post: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, id, anchors): which documents hold which anchors of each query's working set (query_id, type, normalized)."""
    met = post.join(F.broadcast(entries), ["type", "normalized"])
    return met.groupBy("query_id", F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("normalized")).alias("anchors"))


def expired(post: DataFrame, planned: DataFrame, retired: DataFrame) -> DataFrame:
    """(query_id, n_expired): retired documents that a query's anchors would have met."""
    met = post.join(F.broadcast(planned.select("query_id", "folded")), "folded").join(retired, ["document_id", "version"], "left_semi")
    return met.groupBy("query_id").agg(F.count_distinct("document_id", "version").alias("n_expired"))
