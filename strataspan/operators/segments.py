"""Windows, spans and chunks of documents, and their reassembly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspan.functions import text as tx
from strataspan.functions.batches import SLICE, map_slices


def token_windows(docs: DataFrame, size: int = 900, overlap: int = 135) -> DataFrame:
    """(document_id, ordinal, start_token, end_token): sliding count windows, native."""
    n = F.size(F.regexp_extract_all("text", F.lit(tx.WINDOW_TOKEN), F.lit(0)))
    step = size - overlap
    counted = docs.select("document_id", n.alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    each = counted.select("document_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    return each.select("document_id", "ordinal", (F.col("ordinal") * step).alias("start_token"), F.least(F.col("n"), F.col("ordinal") * step + size).alias("end_token"))


def byte_windows(docs: DataFrame, size: int = 900, overlap: float = 0.15) -> DataFrame:
    """(document_id, version, ordinal, start_byte, end_byte): windows in UTF-8 bytes, which cover the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, v, *w) for d, v, t in zip(b["document_id"], b["version"], b["text"], strict=True) for w in tx.windows(t or "", size, overlap)]
            yield pd.DataFrame(rows, columns=["document_id", "version", "ordinal", "start_byte", "end_byte"])

    return map_slices(versioned(docs), run, "document_id long, version int, ordinal int, start_byte long, end_byte long")


def versioned(docs: DataFrame, *keys: str) -> DataFrame:
    """(document_id, version, text, keys); version 1 where docs have none."""
    version = F.col("version").cast("int") if "version" in docs.columns else F.lit(1)
    return docs.select(F.col("document_id").cast("long"), version.alias("version"), "text", *keys)


def physical_chunks(docs: DataFrame, most: int = 65_536, least_line: int = 16_384, *keys: str) -> DataFrame:
    """(document_id, version, keys, ordinal, start_byte, end_byte, content, chunk_id): content-addressed pieces; null and empty texts have none. keys name further columns, as what tells rows of one id apart."""
    own = ["document_id", "version", *keys]
    slim = versioned(docs, *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            owner, pieces = [], []
            for n, t in enumerate(b.column("text").to_pylist()):
                raw = (t or "").encode()
                cut = tx.chunks(t or "", most, least_line)
                owner += [n] * len(cut)
                pieces += [(i, a, e, raw[a:e].decode()) for i, a, e in cut]
            ordinal, start, end, content = zip(*pieces, strict=True) if pieces else ([],) * 4
            kept = [b.column(c).take(pa.array(owner, pa.int64())) for c in own]  # ids stay as they are, nulls too
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ordinal, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(content, pa.string())], names=[*own, "ordinal", "start_byte", "end_byte", "content"])

    kinds = "".join(f"`{c}` {slim.schema[c].dataType.simpleString()}, " for c in own)
    cut = slim.mapInArrow(run, kinds + "ordinal int, start_byte long, end_byte long, content string")
    return cut.withColumn("chunk_id", F.concat(F.lit("sha256:"), F.sha2("content", 256)))


def reconstructed(chunks: DataFrame, *keys: str) -> DataFrame:
    """(document_id, version, keys, n_chunks, byte_length, content_hash, gap_free) of documents put together from their chunks."""
    own = ["document_id", "version", *keys]
    parts = chunks.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("ordinal", "start_byte", "end_byte", "content"))).alias("p"))
    text = F.array_join(F.transform("p", lambda c: c["content"]), "")
    gaps = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: F.when(i == 1, F.col("p")[0]["start_byte"] == 0).otherwise(F.col("p")[i - 1]["start_byte"] == F.col("p")[F.greatest(i - 2, F.lit(0))]["end_byte"]))
    return parts.select(*own, F.size("p").cast("long").alias("n_chunks"), F.octet_length(text).cast("long").alias("byte_length"), F.sha2(text, 256).alias("content_hash"), gaps.alias("gap_free"))


def read_range(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(document_id, version, start, end, content): bytes of ranges (document_id, version, start, end), from the chunks that they meet only.

    The join has document and version as equal keys, and the interval as a condition on their few chunks. A range is moved inward to character boundaries.
    """
    met = ranges.join(chunks, ["document_id", "version"]).where((F.col("start_byte") < F.col("end")) & (F.col("end_byte") > F.col("start")))
    a, b = F.greatest("start", "start_byte"), F.least("end", "end_byte")
    part = met.withColumn("piece", F.substr(F.col("content").cast("binary"), (a - F.col("start_byte") + 1).cast("int"), (b - a).cast("int")))
    got = part.groupBy("document_id", "version", "start", "end").agg(F.array_sort(F.collect_list(F.struct("start_byte", F.hex("piece").alias("h")))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["h"]), "")
    # continuation bytes at the start, and a lead byte without all of its continuation at the end, are of characters that the range splits
    inner = F.regexp_replace(whole, "^(?:[89AB].)+", "")
    return got.select("document_id", "version", "start", "end", F.decode(F.unhex(cut_end(inner)), "UTF-8").alias("content"))


def cut_end(h: Column) -> Column:
    """Hexadecimal UTF-8 without a last character that isn't whole."""

    def lead(back: int, least: str) -> Column:
        at = F.substring(F.substr(h, F.greatest(F.lit(1), F.length(h) - 2 * back + 1), F.lit(2)), 1, 2)
        return (F.length(h) >= 2 * back) & (at >= least)

    n = F.length(h)
    return (
        F.when(lead(1, "C0"), F.substr(h, F.lit(1), n - 2)).when(lead(2, "E0"), F.substr(h, F.lit(1), n - 4)).when(lead(3, "F0"), F.substr(h, F.lit(1), n - 6)).otherwise(h)
    )


def windows_for_range(wins: DataFrame, ranges: DataFrame) -> DataFrame:
    """(document_id, version, start, end, ordinal, contains) of the stored windows (document_id, version, ordinal, start_byte, end_byte) that each range meets."""
    met = ranges.join(wins, ["document_id", "version"]).where((F.col("start_byte") < F.col("end")) & (F.col("end_byte") > F.col("start")))
    return met.select("document_id", "version", "start", "end", "ordinal", ((F.col("start_byte") <= F.col("start")) & (F.col("end_byte") >= F.col("end"))).alias("contains"))


def window_for_range(wins: DataFrame, ranges: DataFrame) -> DataFrame:
    """(document_id, version, start, end, ordinal): the first window that contains each range, or else the first that it meets."""
    best = windows_for_range(wins, ranges).groupBy("document_id", "version", "start", "end").agg(F.min(F.struct((~F.col("contains")).alias("out"), "ordinal")).alias("w"))
    return best.select("document_id", "version", "start", "end", "w.ordinal")


def recall_windows(wins: DataFrame, asked: DataFrame) -> DataFrame:
    """(document_id, version, ordinal, first, last, start_byte, end_byte) for each asked window (document_id, version, ordinal, neighbors, max_bytes): it and its neighbours, without
    the farther ones that don't fit in max_bytes.

    Windows are dropped one by one from the side that is farther away, the right one first; so the widest range that fits is the last one that is tried.
    """
    near = asked.withColumnRenamed("ordinal", "at").join(wins, ["document_id", "version"]).where(F.abs(F.col("ordinal") - F.col("at")) <= F.col("neighbors"))
    rows = near.groupBy("document_id", "version", "at", "max_bytes").agg(F.array_sort(F.collect_list(F.struct("ordinal", "start_byte", "end_byte"))).alias("w"))
    target = F.array_position(F.transform("w", lambda x: x["ordinal"]), F.col("at")).cast("int") - 1

    def shrink(acc, _):
        first, last = acc["first"], acc["last"]
        fits = F.get(F.col("w"), last)["end_byte"] - F.get(F.col("w"), first)["start_byte"] <= F.col("max_bytes")
        right = (last - acc["at"] >= acc["at"] - first) & (last > acc["at"])
        stay = fits | (first >= last)
        return F.struct(F.when(stay | right, first).otherwise(F.least(first + 1, acc["at"])).alias("first"), F.when(stay | ~right, last).otherwise(last - 1).alias("last"), acc["at"].alias("at"))

    start = F.struct(F.lit(0).alias("first"), (F.size("w") - 1).alias("last"), target.alias("at"))
    got = rows.withColumn("r", F.aggregate("w", start, shrink))
    a, b = F.get(F.col("w"), F.col("r.first")), F.get(F.col("w"), F.col("r.last"))
    return got.select("document_id", "version", F.col("at").alias("ordinal"), a["ordinal"].alias("first"), b["ordinal"].alias("last"), a["start_byte"].alias("start_byte"), b["end_byte"].alias("end_byte"))


def clipped(start: Column, end: Column, total: Column, most: int) -> Column:
    """Struct (start, end) of at most most bytes around the middle of a range, within 0 to total."""
    a = F.greatest(F.lit(0), F.least(F.floor((start + end - most) / 2), total - most)).cast("long")
    return F.when(end - start <= most, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))).otherwise(F.struct(a.alias("start"), F.least(total, a + most).cast("long").alias("end")))
