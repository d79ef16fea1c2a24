"""Versions, supersession, liveness, retention, traversal and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspan.operators.ranking import CLASS_OF_KIND, LIFETIME_MS, by_name


def live(documents: DataFrame, retired: DataFrame) -> DataFrame:
    """Documents without a row in retired (document_id, version)."""
    return documents.join(retired.select("document_id", "version").distinct(), ["document_id", "version"], "left_anti")


def newest_versions(documents: DataFrame) -> DataFrame:
    """The newest version of each document_id, found by a partial aggregate, not by a window."""
    top = documents.groupBy("document_id").agg(F.max("version").alias("version"))
    return documents.join(top, ["document_id", "version"])


def chain_view(links: DataFrame, rounds: int = 12) -> DataFrame:
    """(id, position, total) along supersession links (id, supersedes), by pointer doubling: 2 ** rounds hops are followed, cycles end there.

    Each document has at most one predecessor and one successor; ids are numbers. Only rows of links and their ends are touched.
    """

    def hops(step: DataFrame) -> DataFrame:
        at = step.select("id", "to", F.lit(1).cast("long").alias("n"))
        for _ in range(rounds):
            nxt = at.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
            at = at.join(nxt, "to", "left").select("id", F.coalesce("to2", "to").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
        return at.select("id", "n")

    ends = links.select("id").union(links.select("supersedes")).distinct()
    before = hops(links.select("id", F.col("supersedes").alias("to"))).withColumnRenamed("n", "before")
    after = hops(links.select(F.col("supersedes").alias("id"), F.col("id").alias("to"))).withColumnRenamed("n", "after")
    both = ends.join(before, "id", "left").join(after, "id", "left").fillna(0)
    return both.select("id", (F.col("before") + 1).alias("position"), (F.col("before") + 1 + F.col("after")).alias("total"))


def live_subjects(documents: DataFrame) -> DataFrame:
    """(project, subject_key, document_id): the latest document of each subject."""
    latest = documents.where("subject_key IS NOT NULL").groupBy("project", "subject_key").agg(F.max(F.struct("created_at", "document_id")).alias("m"))
    return latest.select("project", "subject_key", "m.document_id")


def retention(documents: DataFrame) -> DataFrame:
    """Adds retention_class by kind and expires_at (null: never), counted from source time."""
    cls = F.coalesce(by_name(CLASS_OF_KIND, F.col("kind")), F.lit("conversation-source"))
    return documents.withColumn("retention_class", cls).withColumn("expires_at", F.col("created_at") + by_name(LIFETIME_MS, F.col("retention_class")))


def due(documents: DataFrame, now: int, protected: DataFrame) -> DataFrame:
    """Documents past their expiry that nothing protects."""
    return retention(documents).where(F.col("expires_at") <= now).join(protected.select("document_id").distinct(), "document_id", "left_anti")


def retention_status(documents: DataFrame, now: int) -> DataFrame:
    kept = retention(documents).withColumn("bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    past = F.col("expires_at") <= now
    return kept.groupBy("retention_class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_if(past).alias("n_due"), F.sum(F.when(past, F.col("bytes")).otherwise(0)).alias("bytes_due"))


def evicted(documents: DataFrame, target_bytes: int) -> DataFrame:
    """Per session, documents to delete in order (kind priority, age, id) until target_bytes are freed: (session_id, document_id, freed_before)."""
    order = Window.partitionBy("session_id").orderBy("priority", "created_at", "document_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = documents.withColumn("priority", by_name({"tool-result": 0, "turn": 1, "decision-candidate": 2}, F.col("kind"), 4)).withColumn("bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    return ranked.withColumn("freed_before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).where(F.col("freed_before") < target_bytes).select("session_id", "document_id", "freed_before")


def neighbours(documents: DataFrame, anchors: DataFrame, before: int = 1, after: int = 3) -> DataFrame:
    """(anchor_id, document_id, distance): documents of an anchor's project around it in order of time and id; distance is negative before it."""
    at = Window.partitionBy("project").orderBy("created_at", "document_id")
    placed = documents.select("project", "document_id", F.row_number().over(at).alias("place"))
    own = placed.join(anchors.select(F.col("document_id")), "document_id").select("project", F.col("document_id").alias("anchor_id"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("distance"), "place")
    wanted = own.select("project", "anchor_id", "distance", (F.col("place") + F.col("distance")).alias("place"))
    return wanted.join(placed, ["project", "place"]).select("anchor_id", "document_id", F.col("distance").cast("long"))
