"""A conversation's messages: limits and rotation, tool calls and results, previews, catalogues of archived turns, and the epoch state of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspan.functions import columns as cx
from strataspan.functions import text as tx

#: Shares of the input window at which a session is rotated, and at most filled; budget of tool results.
ROTATION_RATIO, HARD_RATIO, RESULT_TOKENS, RESULT_RATIO, RESULT_FLOOR = 0.65, 0.8, 4_000, 0.3, 1_000


def limits(window: Column, reserve: Column, rotation_ratio: float = ROTATION_RATIO, hard_ratio: float = HARD_RATIO) -> Column:
    """Struct (rotation_tokens, hard_limit_tokens): shares of the input window, which is what the reserve for output leaves; the first is never above the second."""
    room = F.greatest(F.lit(0), window - F.coalesce(reserve, F.lit(0)))
    hard = F.greatest(F.lit(1), F.floor(room * hard_ratio))
    return F.struct(F.least(F.greatest(F.lit(1), F.floor(room * rotation_ratio)), hard).cast("long").alias("rotation_tokens"), hard.cast("long").alias("hard_limit_tokens"))


def must_rotate(tokens: Column, turns: Column, rotation_tokens: Column, rotation_turns: Column | int, forced: Column | None = None) -> Column:
    """forced, tokens, turns, or null: what asks for a rotation, if anything."""
    most = F.lit(rotation_turns) if isinstance(rotation_turns, int) else rotation_turns
    return F.when(forced if forced is not None else F.lit(False), "forced").when(tokens >= rotation_tokens, "tokens").when((most > 0) & (turns >= most), "turns")


def result_budget(rotation_tokens: Column) -> Column:
    """Struct (each, budget, floor) in tokens for tool results."""
    return F.struct(F.lit(RESULT_TOKENS).alias("each"), F.greatest(F.lit(1), F.floor(rotation_tokens * RESULT_RATIO)).cast("long").alias("budget"), F.least(F.lit(RESULT_TOKENS), F.lit(RESULT_FLOOR)).alias("floor"))


def without_empty_errors(messages: DataFrame) -> DataFrame:
    """Messages without assistant ones that failed before they said anything (role, stop_reason, text)."""
    empty = (F.col("role") == "assistant") & (F.col("stop_reason") == "error") & (F.trim(F.coalesce("text", F.lit(""))) == "")
    return messages.where(~F.coalesce(empty, F.lit(False)))


def from_boundary(messages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, key) from each conversation's boundary message (conv_id, boundary_key) on, with found; all of them where there is none or it isn't found."""
    at = messages.join(boundaries, "conv_id").where("key = boundary_key").groupBy("conv_id").agg(F.min("turn").alias("_from"))
    met = messages.join(boundaries.select("conv_id", "boundary_key"), "conv_id", "left").join(at, "conv_id", "left")
    return met.where("_from IS NULL OR turn >= _from").withColumn("found", F.col("boundary_key").isNull() | F.col("_from").isNotNull()).drop("_from", "boundary_key")


def last_turns(messages: DataFrame, n: int) -> DataFrame:
    """Messages of each conversation's last n turns; a turn starts with a user message."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w), F.lit(0))
    return messages.withColumn("_behind", behind).where(F.col("_behind") < n).drop("_behind")


def with_arguments(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool results (conv_id, call_id, ...) with the name and arguments of their call (conv_id, call_id, tool, arguments), the first one of an id."""
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "tool", "arguments")).alias("c")).select("conv_id", "call_id", "c.tool", "c.arguments")
    return results.join(first, ["conv_id", "call_id"], "left")


def repeated_results(results: DataFrame) -> DataFrame:
    """results (conv_id, turn, tool, arguments, text) with first_turn, the turn of the equal result before, or null."""
    w = Window.partitionBy("conv_id", "tool", "arguments", F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy("turn")
    first = F.first("turn").over(w)
    return results.withColumn("first_turn", F.when(first != F.col("turn"), first))


def preview(text: Column, most: int, head: float = 0.7) -> Column:
    """The start and the end of a text that is longer than most characters, with what is left out in between."""
    a = int(most * head)
    b = most - a
    left_out = F.length(text) - most
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, a), F.lit("\n… "), left_out.cast("string"), F.lit(" characters …\n"), F.substring(text, -b, b))).otherwise(text)


def structural_rows(messages: DataFrame, scores: DataFrame) -> DataFrame:
    """(conv_id, turn, role, score, text) of user and assistant messages: their best structural score."""
    best = scores.select("conv_id", "turn", F.greatest("question", "request", "correction", "answer").alias("score"))
    return messages.where(F.col("role").isin("user", "assistant")).join(best, ["conv_id", "turn"]).select("conv_id", "turn", "role", "score", "text")


def salient(messages: DataFrame, most: int = 8) -> DataFrame:
    """(conv_id, turn, rank, term): salient terms of each message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, t, i + 1, term) for c, t, text in zip(b["conv_id"], b["turn"], b["text"], strict=True) for i, term in enumerate(tx.salient_terms(text or "", most))]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "rank", "term"])

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text").mapInPandas(run, "conv_id long, turn long, rank int, term string")


def fact_sentences(messages: DataFrame, most: int = 5) -> DataFrame:
    """(conv_id, turn, rank, sentence, type, value): sentences that state a value, a path or a URL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, t, i + 1, *f) for c, t, text in zip(b["conv_id"], b["turn"], b["text"], strict=True) for i, f in enumerate(tx.facts(text or "", most))]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "rank", "sentence", "type", "value"])

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text").mapInPandas(run, "conv_id long, turn long, rank int, sentence string, type string, value string")


def catalogue(entries: DataFrame, budget_tokens: int = 1_000, header: int = 60) -> DataFrame:
    """(conv_id, n, first_kept, tokens) of catalogue entries (conv_id, turn_group, line): the newest whose lines, with a header, fit the budget; the newest one always."""
    sized = entries.withColumn("chars", F.length("line") + 1)
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn_group")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("k", F.count(F.lit(1)).over(back)).withColumn("tokens", F.ceil((F.sum("chars").over(back) + header) / 4.0))
    kept = placed.where((F.col("tokens") <= budget_tokens) | (F.col("k") == 1))
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn_group").alias("first_kept"), F.max("tokens").alias("tokens"))


def filled(packets: DataFrame, budget: int) -> DataFrame:
    """Rows of (packet_id, place, tokens) taken in order as long as they fit; one that doesn't fit is passed over, later ones may still fit. At most two dozen a packet: a
    fold inside one expression."""
    rows = packets.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("tokens").cast("long").alias("tokens")))).alias("r"))

    def step(acc, x):
        fits = acc["used"] + x["tokens"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["tokens"]).otherwise(0)).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x["place"]))).otherwise(acc["taken"]).alias("taken"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))
    return rows.select("packet_id", F.explode(F.aggregate("r", start, step, lambda a: a["taken"])).alias("place"))


def epochs(messages: DataFrame, rotation_tokens: int, retain_turns: int = 4, reserve: int = 1_000) -> DataFrame:
    """(conv_id, turn, turn_group, epoch, archived_at) of messages (conv_id, turn, role, tokens): the session's state after each message.

    A session grows until its window's tokens reach the limit at a user message. Then the turns before the kept suffix (at most retain_turns whole turns that fit with the reserve)
    are archived and a new epoch starts; archived_at says at which epoch's start a message left the window. Where the window starts depends on all rotations
    before, so a conversation is walked in order, within its group; it is one session's messages.
    """

    def walk(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("turn", kind="stable").reset_index(drop=True)
        group = (g["role"] == "user").cumsum().to_numpy()
        tokens, first, epoch = g["tokens"].fillna(0).to_numpy(), 0, 0
        epochs_, archived = [0] * len(g), [None] * len(g)
        for i in range(len(g)):
            if g["role"][i] == "user" and i > first and tokens[first:i].sum() + tokens[i] >= rotation_tokens:
                keep, starts = i, [j for j in range(first, i) if g["role"][j] == "user"]
                for n, j in enumerate(reversed(starts), 1):
                    if n >= retain_turns or tokens[j : i + 1].sum() + reserve > rotation_tokens:
                        break
                    keep = j
                if keep > first:
                    epoch += 1
                    for j in range(first, keep):
                        archived[j] = epoch
                    first = keep
            epochs_[i] = epoch
        return pd.DataFrame({"conv_id": g["conv_id"], "turn": g["turn"], "turn_group": group, "epoch": epochs_, "archived_at": pd.array(archived, dtype="Int32")})

    slim = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("tokens").cast("long"))
    return slim.groupBy("conv_id").applyInPandas(walk, "conv_id long, turn long, turn_group int, epoch int, archived_at int")


def checkpoints(messages: DataFrame, states: DataFrame) -> DataFrame:
    """(conv_id, epoch, document_id, n_messages, first_turn, last_turn, topic, text) of the messages that each rotation archives, whole and in order."""
    gone = messages.join(states.where("archived_at IS NOT NULL").select("conv_id", "turn", F.col("archived_at").alias("epoch")), ["conv_id", "turn"])
    line = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), cx.serialized_message(F.col("role"), F.lit(None).cast("string"), F.col("text")).alias("s"), F.coalesce("text", F.lit("")).alias("t"))
    parts = gone.groupBy("conv_id", "epoch").agg(F.array_sort(F.collect_list(line)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["s"]), "\n\n")
    user = F.get(F.filter("p", lambda x: x["role"] == "user"), F.lit(0))["t"]
    return parts.select("conv_id", "epoch", cx.document_key(F.col("conv_id"), F.lit("checkpoint"), F.col("epoch"), text).alias("document_id"), F.size("p").cast("long").alias("n_messages"), F.get("p", F.lit(0))["turn"].alias("first_turn"), F.element_at("p", -1)["turn"].alias("last_turn"), cx.topic(user).alias("topic"), text.alias("text"))
