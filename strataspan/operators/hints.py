"""Automatic hints: one frozen decision for each user message, by intent, strength of the evidence, age, cooldown and budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspan.functions import columns as cx
from strataspan.operators import feedback, lifecycle

#: Cooldown of a source within a lineage, time after which a session's hints are abandoned.
COOLDOWN_MS, ABANDONED_MS = 86_400_000, 30 * 86_400_000


def eligible(candidates: DataFrame, documents: DataFrame, retired: DataFrame, now: int, days: dict[str, int]) -> DataFrame:
    """candidates with reason: why their document (document_id, version, kind, created_at) may not be disclosed, or null: candidate-not-live, superseded-source
    or retention-policy."""
    aged = lifecycle.retention(documents).select("document_id", "version", "retention_class", "created_at")
    gone = retired.groupBy("document_id", "version").agg(F.max("status").alias("gone"))
    met = candidates.join(aged, ["document_id", "version"], "left").join(gone, ["document_id", "version"], "left")
    fine = cx.automatically_eligible(F.col("retention_class"), F.col("created_at"), F.lit(now), days)
    reason = F.when(F.col("gone") == "superseded", "superseded-source").when(F.col("gone").isNotNull() | F.col("created_at").isNull(), "candidate-not-live").when(~fine, "retention-policy")
    return met.withColumn("reason", reason).drop("retention_class", "created_at", "gone")


def surfaced(hints: DataFrame, exposures: DataFrame, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """hints (lineage, document_id, at_ms, ...) with seen: whether an exposure (lineage, document_id, shown_ms) lies within the cooldown before it."""
    times = exposures.select("lineage", "document_id", F.col("shown_ms").alias("_t"))
    key = ["lineage", "document_id"]
    # the last exposure before each hint: one window over both, not a join of all pairs
    both = hints.select("*", F.lit(None).cast("long").alias("_t"), F.col("at_ms").alias("_at")).unionByName(times.withColumn("_at", F.col("_t")), allowMissingColumns=True)
    last = F.last("_t", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_at", F.col("_t").isNull()).rowsBetween(Window.unboundedPreceding, -1))
    seen = F.coalesce(F.col("_at") - last < cooldown_ms, F.lit(False))
    return both.withColumn("seen", seen).where("_t IS NULL").drop("_t", "_at")


def decided(messages: DataFrame, candidates: DataFrame, budget_tokens: int = 120) -> DataFrame:
    """(message_id, outcome, reason, document_id, text, tokens): the decision for each message (message_id, text).

    candidates: the best one of each message, (message_id, document_id, kind, mode, words, coverage, max_idf, margin, anchors, excerpt, created_at, reason, seen); a message
    without one, or whose text can't be brought under the budget, is suppressed.
    """
    met = messages.select("message_id", F.col("text").alias("_message")).join(candidates, "message_id", "left").withColumn("_i", cx.intent(F.col("_message")))
    some, i = F.col("document_id").isNotNull(), F.col("_i")
    recall = i["historical"] & (F.col("kind") == "decision-candidate")
    strong = F.coalesce(F.when(F.col("mode") == "exact", F.size("anchors") > 0).otherwise((F.col("mode") == "lexical") & cx.strong_lexical(F.col("words"), F.col("coverage"), F.col("max_idf"), recall)), F.lit(False))
    fine = F.col("reason").isNull() & ~F.coalesce(F.col("seen"), F.lit(False))
    outcome = feedback.disclosure(i["historical"], i["current_only"], i["general"], fine, strong, cx.ambiguous(F.col("margin")), F.coalesce("kind", F.lit("")))
    why = (
        F.when(~some, "no-candidate").when(i["current_only"], "current-state-required").when(i["general"], "general-knowledge").when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("seen"), "source-cooldown").when(~strong, "weak-evidence").when(F.col("_o") == "historical-snippet", "explicit-history-strong-evidence")
        .when(i["historical"], "ambiguous-history-continuity").when(F.col("_o") == "suppress", "source-ineligible").otherwise("implicit-concept-continuity")
    )
    judged = met.withColumn("_o", F.when(some, outcome).otherwise("suppress")).withColumn("_why", why)
    head = F.concat(F.lit("[earlier record of "), cx.source_date(F.col("created_at")), F.lit(", quoted data; verify current state] "))
    # a snippet is shortened to what the budget leaves; a marker has one length
    snippet = F.substring(F.concat(head, F.col("excerpt")), 1, budget_tokens * 4)
    text = F.when(F.col("_o") == "historical-snippet", snippet).when(F.col("_o") == "continuity-marker", cx.continuity_marker(F.col("anchors")))
    sized = judged.withColumn("_text", text).withColumn("_tokens", cx.estimated_tokens(F.col("_text")))
    over = (F.col("_o") != "suppress") & (F.col("_text").isNull() | (F.col("_tokens") > budget_tokens) | ((F.col("_o") == "historical-snippet") & (F.length(head) >= budget_tokens * 4)))
    final = F.when(over, "suppress").otherwise(F.col("_o"))
    shown = final != "suppress"
    return sized.select("message_id", final.alias("outcome"), F.when(over, "hint-budget").otherwise(F.col("_why")).alias("reason"), F.when(shown, F.col("document_id")).alias("document_id"), F.when(shown, F.col("_text")).alias("text"), F.when(shown, F.col("_tokens")).otherwise(0).alias("tokens"))


def frozen(decisions: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New decisions (session_id, message_id, message_hash, ...) and conflicts: of a message that is stored already the stored decision stays, and if its
    text was another one the request is a conflict."""
    key = ["session_id", "message_id"]
    old = stored.select(*key, F.col("message_hash").alias("_hash"))
    fresh = decisions.join(old.select(*key), key, "left_anti")
    return fresh, decisions.join(old, key).where("message_hash != _hash").drop("_hash")


def from_lineage(asked: DataFrame, stored: DataFrame, lineage: DataFrame) -> DataFrame:
    """(session_id, message_id, ...) of the nearest ancestor's stored decision for each asked message (session_id, message_id); lineage is (session_id, ancestor_id, depth)."""
    own = stored.withColumnRenamed("session_id", "ancestor_id")
    met = asked.join(lineage, "session_id").join(own, ["ancestor_id", "message_id"])
    others = [c for c in own.columns if c not in ("ancestor_id", "message_id")]
    return met.groupBy("session_id", "message_id").agg(F.min(F.struct("depth", "ancestor_id", *others)).alias("h")).select("session_id", "message_id", *[f"h.{c}" for c in ("ancestor_id", "depth", *others)])


def within_budget(hints: DataFrame, active: DataFrame, epoch_budget: int, active_budget: int) -> DataFrame:
    """hints (session_id, seq, message_id, tokens) that still fit when taken in order: the sum of a session's tokens, and that of its active messages (session_id,
    message_id) alone."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = hints.join(active.select("session_id", "message_id").distinct().withColumn("_live", F.lit(True)), ["session_id", "message_id"], "left")
    summed = live.withColumn("spent", F.sum("tokens").over(w)).withColumn("active_spent", F.sum(F.when(F.col("_live"), F.col("tokens")).otherwise(0)).over(w))
    return summed.where((F.col("spent") <= epoch_budget) & (F.col("active_spent") <= active_budget)).drop("_live")


def abandoned(hints: DataFrame, touches: DataFrame, now: int, after_ms: int = ABANDONED_MS) -> DataFrame:
    """Hints of sessions that were last touched (session_id, at_ms), or whose hints were last made, longer ago than after_ms."""
    last = hints.select("session_id", "at_ms").unionByName(touches.select("session_id", "at_ms")).groupBy("session_id").agg(F.max("at_ms").alias("last"))
    return hints.join(last.where(F.col("last") < now - after_ms), "session_id", "left_semi")


def removed(hints: DataFrame, keys: DataFrame) -> DataFrame:
    """Hints without those of these messages (session_id, message_id)."""
    return hints.join(keys.select("session_id", "message_id").distinct(), ["session_id", "message_id"], "left_anti")
