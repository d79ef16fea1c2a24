"""Chat formatting in relational form, with Spark expressions only.

Turns of a conversation are collected as structs and sorted; runs of turns with one role are merged by slicing the sorted array at the
places where the role changes; blocks are concatenated to one text, beside a run-length mask of the parts on which a model is trained.

    <turn>ROLE, line end, TEXT<next/>TEXT</turn>, line end

Control strings inside roles and texts, and the escape sign, are escaped so that the format can be read back exactly: \\ is written \\b,
and the < of <turn>, </turn> and <next/> is written \\l; in roles a line end is written \\n.

Null texts and roles count as empty. Turns are ordered by number (null first), then role, then text, so that repeated numbers have one
order. Rows with a null conv_id form one conversation. A conversation is one value and so is built in one task, as its digests need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT = "<turn>", "</turn>\n", "<next/>"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for control in (OPEN, CLOSE[:-1], NEXT):
        out = F.replace(out, F.lit(control), F.lit("\\l" + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and mask (array of (len, loss), code points, in order), a row for each conv_id of turns (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    n = F.size("turns")
    changes = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.col("turns")[i - 1]["role"] != F.col("turns")[i - 2]["role"]))
    starts = chats.withColumn("starts", changes)
    blocks = F.transform("starts", lambda s, k: F.struct(
        F.col("turns")[s - 1]["role"].alias("role"),
        F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s).alias("same"),
    ))
    merged = starts.withColumn("blocks", blocks)

    def pieces(b: Column) -> Column:
        loss, nothing = b["role"] == trained_role, F.lit(False)
        head = F.array(F.struct(F.concat(F.lit(OPEN), escaped_role(b["role"]), F.lit("\n")).alias("s"), nothing.alias("loss")))
        texts = F.flatten(F.transform(b["same"], lambda t, k: F.array(
            F.struct(F.when(k == 0, F.lit("")).otherwise(F.lit(NEXT)).alias("s"), nothing.alias("loss")),
            F.struct(escaped(t["text"]).alias("s"), loss.alias("loss")),
        )))
        return F.concat(head, texts, F.array(F.struct(F.lit(CLOSE).alias("s"), nothing.alias("loss"))))

    cut = merged.withColumn("pieces", F.flatten(F.transform("blocks", pieces)))
    return cut.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.length(p["s"]).alias("len"), p["loss"].alias("loss"))).alias("mask"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of (role, text)) and loss_text, both read back from formatted and mask alone."""
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != "")

    def turns(b: Column) -> Column:
        body = F.substring(b, len(OPEN) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substr(body, F.length(role) + 2), NEXT)
        return F.transform(texts, lambda t: F.struct(unescaped_role(role).alias("role"), unescaped(t).alias("text")))

    ends = F.aggregate(
        "mask",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,len:int>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["len"]).alias("at"),
            F.when(m["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("at"), m["len"].alias("len"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    masked = F.transform(ends, lambda s: unescaped(F.substr(F.col("formatted"), s["at"], s["len"])))
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns))).withColumn("loss_text", F.array_join(masked, ""))


def chat_digests(formatted: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_digests(format_chats(turns.unionByName(extra)))


_ESC = r"replace(replace(replace(replace(text, '\', '\b'), '<turn>', '\lturn>'), '</turn>', '\l/turn>'), '<next/>', '\lnext/>')"
_ROLE = _ESC.replace("replace(text,", "replace(role,")
OP5_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS merged,
      length({_ESC}) AS n, length(replace({_ROLE}, chr(10), '\n')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN merged THEN length('<next/>') ELSE length('<turn>') + r + 1 + length('</turn>') + 1 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
