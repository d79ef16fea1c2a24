"""Turns, structural scores and relations of messages, decision and fact sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspan.functions import text as tx
from strataspan.functions.batches import map_slices

#: A relation is resolved from this confidence; a text without messages is kept as a whole up to so many bytes.
RESOLVED, WHOLE_BYTES = 50, 64 * 1024
WORD = r"[\p{L}\p{N}_-]{2,}"
_WORD = regex.compile(WORD)
STORED = "document_id long, version int, project string, session_id string, created_at long, message int, role string, terminal boolean, legacy boolean, decision boolean, text string, start_byte long, end_byte long, words array<string>"
ROWS = "relation string, confidence int, project string, session_id string, created_at long, document_id long, version int, message int, role string, legacy boolean, start_byte long, end_byte long, words array<string>"


def turn_groups(messages: DataFrame) -> DataFrame:
    """(conv_id, turn_group, first_turn, last_turn, n_messages): a turn runs from a user message to the next; messages before the first are group 0."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = messages.withColumn("turn_group", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    return marked.groupBy("conv_id", "turn_group").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n_messages"))


def structural_scores(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, request, correction, answer): scores of each message by role and cue; a conversation's last assistant message answers it."""
    terminal = (F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn"))) == 1) & (F.col("role") == "assistant")
    return messages.select("conv_id", "turn", *_scores(F.col("text"), F.col("role"), terminal))


def _scores(text: Column, role: Column, terminal: Column) -> list[Column]:
    """question, request, correction and answer of a message; terminal says whether it is the last one of an assistant."""
    t = tx.trimmed(F.coalesce(text, F.lit("")))
    some, user = t != "", role == "user"
    return [
        F.when(~some | ~user, 0).when(F.contains(t, F.lit("?")), 100).when(t.rlike(tx.cue(tx.QUESTION_PREFIX)), 85).otherwise(10).alias("question"),
        F.when(~some | ~user, 0).when(t.rlike(tx.cue(tx.REQUEST_PREFIX)), 100).otherwise(10).alias("request"),
        F.when(some & user & t.rlike(tx.cue(tx.CORRECTION_CUE)), 100).otherwise(0).alias("correction"),
        F.when(~some | (role != "assistant"), 0).when(terminal, 100).otherwise(75).alias("answer"),
    ]


def relations(scores: DataFrame) -> DataFrame:
    """(conv_id, turn, relation, confidence): a row for each score above 0."""
    long = scores.selectExpr("conv_id", "turn", "stack(4, 'latest-question', question, 'latest-request', request, 'latest-correction', correction, 'latest-answer', answer) AS (relation, confidence)")
    return long.where("confidence > 0")


def latest(rel: DataFrame) -> DataFrame:
    """Best row of each conversation and relation: confidence, then the latest turn; resolved from confidence 50."""
    w = Window.partitionBy("conv_id", "relation").orderBy(F.desc("confidence"), F.desc("turn"))
    top = rel.withColumn("n", F.row_number().over(w)).where("n = 1")
    return top.select("conv_id", "relation", "turn", "confidence", F.when(F.col("confidence") >= 50, "resolved").otherwise("ambiguous").alias("status"))


def decision_sentences(messages: DataFrame, cues: list[str] | None = None, most: int = 5) -> DataFrame:
    """(conv_id, turn, rank, sentence): sentences of 15 to 300 characters with a cue, no questions, distinct, the first few of each message."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])\s+|\n+", "$1\u0001")
    each = messages.select("conv_id", "turn", F.posexplode(F.split(marked, "\u0001")).alias("pos", "s")).withColumn("sentence", F.trim("s"))
    fine = each.where((F.length("sentence") >= 15) & (F.length("sentence") <= 300) & ~F.endswith("sentence", F.lit("?")) & F.col("sentence").rlike(tx.any_of(cues or tx.DECISION_CUES)))
    once = fine.groupBy("conv_id", "turn", "sentence").agg(F.min("pos").alias("pos"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("pos"))).where(F.col("rank") <= most).select("conv_id", "turn", "rank", "sentence")


def words(text: str) -> list[str]:
    """The different words of two or more characters by which a relation is asked for, sorted."""
    return sorted(set(_WORD.findall((text or "").lower())))


def message_places(raw: bytes, messages: list[bytes]) -> list[tuple[int, int]] | None:
    """The bytes at which messages stand, each searched behind the one before, so in one pass over the text; none if a message is empty or isn't there."""
    out, at = [], 0
    for m in messages:
        start = raw.find(m, at) if m else -1
        if start < 0:
            return None
        at = start + len(m)
        out.append((start, at))
    return out


def stored_relations(docs: DataFrame) -> DataFrame:
    """(relation, confidence, project, session_id, created_at, document_id, version, message, role, legacy, start_byte, end_byte, words): what a document (with messages, an array of (role, score, text)) answers.

    A row for each relation of a message with a text, with the message's bytes in the document. A document with a message that isn't found in order has no rows of its messages. A turn without messages has a row of
    confidence 0 for each relation (legacy), a decision one of latest-decision, if their texts aren't too long to be kept. Texts don't leave the task: rows carry their words only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, v, p, s, c, kind, text, messages in zip(*(b[x] for x in ("document_id", "version", "project", "session_id", "created_at", "kind", "text", "messages")), strict=True):
                text = text or ""
                raw, own = text.encode(), [(i, m["role"], m["text"]) for i, m in enumerate(messages if messages is not None else ()) if m is not None and m["text"] and m["role"] in ("user", "assistant")]
                last = max((i for i, role, _ in own if role == "assistant"), default=-1)
                for (i, role, t), (start, end) in zip(own, message_places(raw, [t.encode() for _, _, t in own]) or (), strict=False):
                    rows.append((d, v, p, s, c, i, role, i == last, False, False, t, start, end, words(t)))
                if raw and len(raw) <= WHOLE_BYTES and (kind == "decision-candidate" or kind == "turn" and (messages is None or not len(messages))):
                    rows.append((d, v, p, s, c, 0, None, False, kind == "turn", kind != "turn", None, 0, len(raw), words(text)))
                if len(rows) > 2_000:
                    yield _stored_frame(rows)
                    rows = []
            yield _stored_frame(rows)

    slim = docs.select("document_id", "version", "project", "session_id", "created_at", "kind", "text", "messages")
    each = map_slices(slim, run, STORED)
    found = each.select("*", *_scores(F.col("text"), F.col("role"), F.col("terminal"))).drop("text")
    names = {"latest-question": "question", "latest-request": "request", "latest-correction": "correction", "latest-answer": "answer"}
    of = [F.struct(F.lit(r).alias("relation"), F.when(F.col("legacy") | F.col("decision"), 0).otherwise(F.col(c)).cast("int").alias("confidence"), (F.col("legacy") | ~F.col("decision") & (F.col(c) > 0)).alias("has")) for r, c in names.items()]
    of.append(F.struct(F.lit("latest-decision").alias("relation"), F.lit(100).alias("confidence"), F.col("decision").alias("has")))
    flat = found.withColumn("r", F.explode(F.array(*of))).where("r.has")
    return flat.select("r.relation", "r.confidence", "project", "session_id", "created_at", "document_id", "version", "message", "role", "legacy", "start_byte", "end_byte", "words")


def _stored_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.strip().split(" ")[0] for x in STORED.split(",")])


def lookup(rows: DataFrame, asked: DataFrame, lineage: DataFrame | None = None, limit: int = 3) -> DataFrame:
    """(query_id, rank, document_id, version, message, role, legacy, confidence, depth, start_byte, end_byte, status): the best rows of stored_relations() for each query (query_id, relation, asked_words), of those that have one
    of its words, or all if it has none.

    lineage (query_id, session_id, depth) restricts a query to its sessions, nearest first; without it all rows given take part. Order: confidence, nearest session, newest, last message. Behind the best comes the best
    legacy row newer than it, which makes the answer ambiguous; so do a confidence below 50, a session that isn't the nearest, and no lineage. Without any other row legacy rows are the answer (legacy-fallback).
    Queries are a page; rows are joined with it by relation and session, and only the first limit rows of a query are ever sorted together.
    """
    if lineage is None:
        met = rows.join(asked, "relation").withColumn("depth", F.lit(0))
    else:
        met = rows.join(asked.join(lineage, "query_id"), ["relation", "session_id"])
    has = (F.size(asked_words := F.coalesce(F.col("asked_words"), F.array().cast("array<string>"))) == 0) | F.arrays_overlap("words", asked_words)
    met = met.where(has).withColumn("seq", F.struct("created_at", "document_id", "version")).drop("words", "asked_words")
    order = [F.desc("confidence"), F.asc("depth"), F.desc("seq"), F.desc("message")]
    own = Window.partitionBy("query_id").orderBy(*order)
    modern = met.where("NOT legacy").withColumn("n", F.row_number().over(own)).where(F.col("n") <= limit)
    top = modern.where("n = 1").select("query_id", F.col("seq").alias("top_seq"), F.col("confidence").alias("top"), F.col("depth").alias("top_depth"))
    old = met.where("legacy").join(top.select("query_id", "top_seq"), "query_id", "left").where("top_seq IS NULL OR seq > top_seq")
    old = old.withColumn("n", F.row_number().over(own)).where(F.col("n") <= limit).where("top_seq IS NULL OR n = 1")
    placed = modern.withColumn("place", F.when(F.col("n") == 1, 0).otherwise(F.col("n"))).drop("n").unionByName(old.withColumn("place", F.when(F.col("top_seq").isNull(), F.col("n")).otherwise(1)).drop("n", "top_seq"))
    newer = old.where("top_seq IS NOT NULL").select("query_id", F.lit(True).alias("newer"))
    unclear = (F.col("top") < RESOLVED) | (F.col("top_depth") > 0) | F.coalesce("newer", F.lit(False)) | F.lit(lineage is None)
    out = placed.join(top.drop("top_seq"), "query_id", "left").join(newer, "query_id", "left").withColumn("status", F.when(F.col("top").isNull(), "legacy-fallback").when(unclear, "ambiguous").otherwise("resolved"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "document_id", "version", "message", "role", "legacy", "confidence", "depth", "start_byte", "end_byte", "status")
