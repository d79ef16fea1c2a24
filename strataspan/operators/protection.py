"""What keeps documents: pins, protections, leases and renewals; what takes them away: expiry, redaction, collection of chunks, purge of projects.

Nothing is updated in place. A pin, a release or a renewal is a row with a sequence number, and the newest row of a key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspan.operators import lifecycle

#: Time to live of a retrieval lease, at most and by default; length of an access bucket.
LEASE_MS, MOST_LEASE_MS, HOUR_MS = 300_000, 3_600_000, 3_600_000


def newest(rows: DataFrame, keys: list[str], by: str = "seq") -> DataFrame:
    """The newest row of each key, by an aggregate that combines map-side."""
    others = [c for c in rows.columns if c not in (*keys, by)]
    top = rows.groupBy(*keys).agg(F.max(F.struct(by, *others)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in (by, *others)])


def pinned(pins: DataFrame) -> DataFrame:
    """(document_id) of pins (pin_id, document_id, seq, active) whose newest row is active."""
    return newest(pins, ["pin_id"]).where("active").select("document_id").distinct()


def pin_status(pins: DataFrame, asked: DataFrame) -> DataFrame:
    """(pin_id, document_id, active, status) of requests (pin_id, document_id, active): pinned, already-pinned, unpinned or not-found."""
    now = newest(pins, ["pin_id"]).select("pin_id", F.col("active").alias("was"))
    was = F.coalesce(F.col("was"), F.lit(False))
    status = F.when(F.col("active"), F.when(was, "already-pinned").otherwise("pinned")).otherwise(F.when(was, "unpinned").otherwise("not-found"))
    return asked.join(now, "pin_id", "left").select("pin_id", "document_id", "active", status.alias("status"))


def held(rows: DataFrame, now: int) -> DataFrame:
    """Rows of protections or leases (owner_id, seq, active, until, ...) that still hold at now: active ones that haven't run out."""
    return newest(rows, ["owner_id"]).where(F.col("active") & (F.col("until").isNull() | (F.col("until") > now)))


def protected(documents: DataFrame, now: int, pins: DataFrame, protections: DataFrame, leases: DataFrame) -> DataFrame:
    """(document_id, version, reasons) of documents (document_id, version, session_id, protect) that something keeps: their own admission, a pin, a protection of
    the document or of its session, an active lease. A union of equi joins; the documents are read once."""
    holds, lease = held(protections, now), held(leases, now)
    marks = [
        pinned(pins).select("document_id", F.lit("pin").alias("reason")),
        holds.where("document_id IS NOT NULL").select("document_id", F.lit("document-protection").alias("reason")),
        lease.select("document_id", F.lit("lease").alias("reason")),
    ]
    by_document = marks[0].unionByName(marks[1]).unionByName(marks[2]).groupBy("document_id").agg(F.collect_set("reason").alias("r"))
    by_session = holds.where("session_id IS NOT NULL").select("session_id").distinct().withColumn("s", F.lit("session-protection"))
    met = documents.select("document_id", "version", "session_id", "protect").join(by_document, "document_id", "left").join(by_session, "session_id", "left")
    none = F.array().cast("array<string>")
    own = F.when(F.col("protect"), F.array(F.lit("admission"))).otherwise(none)
    reasons = F.array_sort(F.concat(own, F.coalesce("r", none), F.when(F.col("s").isNotNull(), F.array("s")).otherwise(none)))
    return met.select("document_id", "version", reasons.alias("reasons")).where(F.size("reasons") > 0)


def lease_until(created_at: Column, ttl_ms: Column | int = LEASE_MS) -> Column:
    return created_at + F.least(F.lit(ttl_ms) if isinstance(ttl_ms, int) else ttl_ms, F.lit(MOST_LEASE_MS))


def lease_status(leases: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """(owner_id, status): active, released, lease-expired or missing, of each asked owner_id."""
    own = newest(leases, ["owner_id"]).select("owner_id", "active", "until")
    status = F.when(F.col("active").isNull(), "missing").when(~F.col("active"), "released").when(F.col("until") <= now, "lease-expired").otherwise("active")
    return asked.select("owner_id").distinct().join(own, "owner_id", "left").select("owner_id", status.alias("status"))


def renewed(documents: DataFrame, renewals: DataFrame) -> DataFrame:
    """documents with expires_at of their newest renewal (document_id, version, generation, expires_at), if they have one; null there means never."""
    top = newest(renewals, ["document_id", "version"], "generation").select("document_id", "version", F.col("expires_at").alias("_until"), F.lit(True).alias("_renewed"))
    met = documents.join(top, ["document_id", "version"], "left")
    return met.withColumn("expires_at", F.when(F.col("_renewed"), F.col("_until")).otherwise(F.col("expires_at"))).drop("_until", "_renewed")


def due(documents: DataFrame, now: int, kept: DataFrame, renewals: DataFrame | None = None, forced: bool = False) -> DataFrame:
    """Documents past their expiry that nothing keeps. Under forced also all tool results of the ephemeral class, whatever their age."""
    aged = lifecycle.retention(documents)
    aged = aged if renewals is None else renewed(aged, renewals)
    past = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    if forced:
        past = past | ((F.col("retention_class") == "ephemeral-payload") & (F.col("kind") == "tool-result"))
    return aged.where(past).join(kept.select("document_id").distinct(), "document_id", "left_anti")


def retention_run(documents: DataFrame, now: int, kept: DataFrame, batch: int, renewals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What one run of at most batch documents takes away, the longest due first, and one row (status, taken, left): complete, more-work, or blocked where all that is
    due is kept."""
    aged = lifecycle.retention(documents)
    aged = aged if renewals is None else renewed(aged, renewals)
    past = aged.where(F.col("expires_at") <= now)
    free = past.join(kept.select("document_id").distinct(), "document_id", "left_anti")
    counts = past.agg(F.count(F.lit(1)).alias("past")).join(free.agg(F.count(F.lit(1)).alias("free")))
    status = F.when((F.col("free") == 0) & (F.col("past") > 0), "blocked").when(F.col("free") > batch, "more-work").otherwise("complete")
    return free.orderBy("expires_at", "document_id").limit(batch), counts.select(status.alias("status"), F.least(F.col("free"), F.lit(batch)).alias("taken"), F.greatest(F.col("free") - batch, F.lit(0)).alias("left"))


def accesses(events: DataFrame, bucket_ms: int = HOUR_MS) -> DataFrame:
    """(document_id, version, bucket): one row for each document and hour in which it was read (document_id, version, at_ms)."""
    return events.select("document_id", "version", F.floor(F.col("at_ms") / bucket_ms).alias("bucket")).distinct()


def unreferenced_chunks(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """(chunk_id, bytes) of chunks (document_id, version, chunk_id, start_byte, end_byte) that no live document (document_id, version) refers to."""
    used = chunks.join(live.select("document_id", "version"), ["document_id", "version"], "left_semi").select("chunk_id").distinct()
    one = chunks.groupBy("chunk_id").agg(F.max(F.col("end_byte") - F.col("start_byte")).alias("bytes"))
    return one.join(used, "chunk_id", "left_anti")


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content): one payload for each content, that of its first place."""
    first = chunks.groupBy("chunk_id").agg(F.min(F.struct("document_id", "ordinal", "content")).alias("c"))
    return first.select("chunk_id", "c.content")


def purgeable(documents: DataFrame, retired: DataFrame) -> DataFrame:
    """Projects without any live document: only their records may be purged."""
    alive = lifecycle.live(documents, retired).select("project").distinct()
    return documents.select("project").distinct().join(alive, "project", "left_anti")


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(namespace, rows, bytes) of index tables: the bytes of their strings and eight for every other value."""
    parts = []
    for name, df in sorted(tables.items()):
        size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes), F.lit(0))
        parts.append(df.agg(F.lit(name).alias("namespace"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def supersession_errors(requests: DataFrame, documents: DataFrame, retired: DataFrame) -> DataFrame:
    """(document_id, target_id, reason) of requests (document_id, project, subject_key, created_at, target_id) that may not supersede their target: it must be another
    document, exist and be live, be of the same project, be strictly older, and have no subject that the new one changes or drops. Cycles can't arise, since every
    target is older."""
    own = documents.select(F.col("document_id").alias("target_id"), F.col("version").alias("tv"), F.col("project").alias("tp"), F.col("subject_key").alias("ts"), F.col("created_at").alias("tc"))
    gone = retired.select(F.col("document_id").alias("target_id"), F.col("version").alias("tv")).distinct().withColumn("gone", F.lit(True))
    met = requests.join(own, "target_id", "left").join(gone, ["target_id", "tv"], "left")
    reason = (
        F.when(F.col("document_id") == F.col("target_id"), "self").when(F.col("tp").isNull(), "missing").when(F.col("gone"), "not-live").when(F.col("tp") != F.col("project"), "project")
        .when(F.col("tc") >= F.col("created_at"), "not-older").when(F.col("ts").isNotNull() & ~F.col("ts").eqNullSafe(F.col("subject_key")), "subject")
    )
    return met.select("document_id", "target_id", reason.alias("reason")).where("reason IS NOT NULL")


def protected_turns(documents: DataFrame, newest_turns: int = 4) -> DataFrame:
    """(session_id, document_id, turn_rank): the newest turns of each session, which pruning leaves alone."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("document_id"))
    return documents.where("kind = 'turn'").withColumn("turn_rank", F.row_number().over(w)).where(F.col("turn_rank") <= newest_turns).select("session_id", "document_id", "turn_rank")
