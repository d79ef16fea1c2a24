"""Relevance feedback, reformulation chains, evaluation metrics, disclosure and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspan.functions import text as tx


def feedback_statistics(shown: DataFrame) -> DataFrame:
    """Totals of (mode, rank, recalled) by mode, by rank and over all, in one pass of grouping sets."""
    sets = shown.groupingSets([["mode"], ["rank"], []], "mode", "rank")
    return sets.agg(F.count(F.lit(1)).alias("shown"), F.count_if("recalled").alias("recalled")).select("mode", "rank", "shown", "recalled")


def reformulations(events: DataFrame) -> DataFrame:
    """(miss_id, hit_id, miss_key, hit_key) of events (seq, query_key, hit, sessions: array): each miss with the hit that ends it, if that asked something else.

    Within a session a hit ends all open misses, and a later miss of one key takes the place of the earlier one. So a session's open misses at a hit are the last
    one of each key since the hit before. A miss of several sessions ends in all of them at its first hit. Windows run backwards, so each row's frame is one step
    longer than the one before it, and nothing is joined with itself.
    """
    each = events.select("seq", "query_key", "hit", F.explode(F.array_distinct("sessions")).alias("session"))
    back = Window.partitionBy("session").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last(F.when(F.col("hit"), F.struct("seq", "query_key")), ignorenulls=True).over(back)
    open_ = each.withColumn("next", ahead).where(~F.col("hit") & F.col("next").isNotNull())
    last = open_.groupBy("session", "query_key", F.col("next.seq").alias("hit_id"), F.col("next.query_key").alias("hit_key")).agg(F.max("seq").alias("miss_id"))
    ended = last.groupBy("miss_id", F.col("query_key").alias("miss_key")).agg(F.min(F.struct("hit_id", "hit_key")).alias("h"))
    return ended.select("miss_id", "h.hit_id", "miss_key", "h.hit_key").where("miss_key != hit_key")


def chain_rate(events: DataFrame, chains: DataFrame) -> DataFrame:
    """One row: chains, events, and chains for each event."""
    return events.agg(F.count(F.lit(1)).alias("events")).join(chains.agg(F.count(F.lit(1)).alias("chains"))).select("events", "chains", F.round(F.col("chains") / F.greatest(F.col("events"), F.lit(1)), 6).alias("rate"))


def attributed(shown: DataFrame, recalled: DataFrame) -> DataFrame:
    """shown (event_id, fingerprint, ...) with recalls: the resolved recalls (event_id, fingerprint, status) of each shown result."""
    hits = recalled.where("status = 'resolved'").groupBy("event_id", "fingerprint").agg(F.count(F.lit(1)).alias("recalls"))
    return shown.join(hits, ["event_id", "fingerprint"], "left").withColumn("recalls", F.coalesce("recalls", F.lit(0)))


def recall_counts(recalled: DataFrame) -> DataFrame:
    """(document_id, version, n): resolved recalls of each version, one for each event and locator."""
    once = recalled.where("status = 'resolved'").select("document_id", "version", "event_id", "fingerprint").distinct()
    return once.groupBy("document_id", "version").agg(F.count(F.lit(1)).alias("n"))


def query_totals(shown: DataFrame, most: int = 20) -> DataFrame:
    """(query_key, searches, shown, recalled) of attributed results (event_id, query_key, recalls): searches, then recalls, then results come first."""
    per = shown.groupBy("query_key").agg(F.count_distinct("event_id").alias("searches"), F.count(F.lit(1)).alias("shown"), F.count_if(F.col("recalls") > 0).alias("recalled"))
    return per.orderBy(F.desc("searches"), F.desc("recalled"), F.desc("shown"), "query_key").limit(most)


def ring(events: DataFrame, most: int = 2_000) -> DataFrame:
    """The newest most events of each project."""
    w = Window.partitionBy("project").orderBy(F.desc("seq"))
    return events.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def recall_and_mrr(results: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """One row: n_queries, recall_at_k, mrr over results (query_id, rank, document_id) and relevant (query_id, document_id)."""
    good = results.join(relevant, ["query_id", "document_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    per = relevant.select("query_id").distinct().join(good, "query_id", "left")
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def disclosure(historical: Column, current_only: Column, general: Column, eligible: Column, strong: Column, ambiguous: Column, kind: Column) -> Column:
    """suppress, historical-snippet or continuity-marker."""
    continuous = kind.isin("conversation", "conversation-source", "decision-candidate", "turn")
    return (
        F.when(~historical & (current_only | general), "suppress").when(~eligible | ~strong, "suppress")
        .when(historical & ~ambiguous, "historical-snippet").when(~historical & ~continuous, "suppress").otherwise("continuity-marker")
    )


def possible_conflicts(items: DataFrame, links: DataFrame | None = None, most: int = 8) -> DataFrame:
    """(packet_id, left_id, right_id) of items (packet_id, item_id, subject, text and, if there, anchors: array of strong folded ones) that share a subject or an anchor, both
    with a decision cue and exactly one with a reversal cue, without a supersession link (id, supersedes) between them; most for each item.

    Items come from evidence packets of at most two dozen, so the join on (packet, subject) stays small; items without a cue leave before it.
    """
    if "anchors" not in items.columns:
        items = items.withColumn("anchors", F.array().cast("array<string>"))
    topics = F.concat(F.when(F.col("subject").isNotNull(), F.array(F.concat(F.lit("s:"), F.col("subject")))).otherwise(F.array().cast("array<string>")), F.transform(F.coalesce("anchors", F.array().cast("array<string>")), lambda a: F.concat(F.lit("a:"), a)))
    cued = items.where(F.col("text").rlike(tx.any_of(tx.DECISION_CUES))).select("packet_id", F.explode(topics).alias("topic"), "item_id", F.col("text").rlike(tx.any_of(tx.REVERSAL_CUES)).alias("reversed"))
    yes, no = cued.where("NOT reversed"), cued.where("reversed")
    pairs = yes.select("packet_id", "topic", F.col("item_id").alias("a")).join(no.select("packet_id", "topic", F.col("item_id").alias("b")), ["packet_id", "topic"])
    found = pairs.select("packet_id", F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).distinct()
    if links is not None:
        ends = links.select(F.least("id", "supersedes").alias("left_id"), F.greatest("id", "supersedes").alias("right_id")).distinct()
        found = found.join(ends, ["left_id", "right_id"], "left_anti")
    ranks = [F.row_number().over(Window.partitionBy("packet_id", a).orderBy(b)) for a, b in (("left_id", "right_id"), ("right_id", "left_id"))]
    return found.withColumn("_l", ranks[0]).withColumn("_r", ranks[1]).where((F.col("_l") <= most) & (F.col("_r") <= most)).select("packet_id", "left_id", "right_id")


def compared(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, status): same, changed, missing or extra; a full outer join on the keys."""
    a, b = expected.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), actual.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))
