"""Exact dedup by a log-structured merge index.

Tasks fill bounded memtables of digests; full memtables flush as runs, sorted by digest, with one entry (digest, largest row, count) for each text. Compaction
deals the runs' entries out by ranges of digests, merges them in order and writes one run a range, with one entry for each digest and a filter of the digests
that several runs hold. Hits are verified byte by byte: within a memtable at once, across runs by one text for each task, which is moved only if the filter of
the digest's run may hold it.

Null texts count as empty; an empty text is a text like any other. Repeated rows, also with one doc_id, form a group of which exactly one row stays, whether
digests collide or not. A null doc_id is below all others. An empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.shared import Scratch, looked_up

#: Bits of all runs' filters together, at most, and for each hit; beyond that filters let more texts pass, never fewer.
MOST_BITS, HIT_BITS, FILTER_PROBES = 1 << 28, 16, 4


def _probes(digests: list[bytes], n_bits: int) -> np.ndarray:
    """Filter positions, a row for each digest. Digests are spread by a second hash, so short ones work as well."""
    full = b"".join(hashlib.blake2b(d, digest_size=4 * FILTER_PROBES).digest() for d in digests)
    return np.frombuffer(full, dtype="<u4").reshape(len(digests), FILTER_PROBES) % np.uint32(n_bits)


def made_filter(digests: list[bytes], most_bits: int) -> bytes:
    """A filter that holds all of these digests."""
    table = np.zeros(max(64, min(most_bits, HIT_BITS * len(digests))), dtype=bool)
    table[_probes(digests, len(table)).ravel()] = True
    return len(table).to_bytes(4) + np.packbits(table, bitorder="little").tobytes()


class RunFilters:
    """The filters of the compacted runs, each with the first and last digest of its run."""

    def __init__(self, runs: list[tuple[bytes, bytes, bytes]]):
        self.runs = sorted(runs)
        self.firsts = [r[0] for r in self.runs]
        self.tables = [(int.from_bytes(bits[:4]), np.frombuffer(bits, dtype=np.uint8, offset=4)) for *_, bits in self.runs]

    def may_hold(self, digests: list[bytes]) -> np.ndarray:
        out = np.zeros(len(digests), dtype=bool)
        by: dict[int, list[int]] = {}
        for i, d in enumerate(digests):
            k = bisect_right(self.firsts, d) - 1
            if k >= 0 and d <= self.runs[k][1]:
                by.setdefault(k, []).append(i)
        for k, own in by.items():
            n_bits, table = self.tables[k]
            at = _probes([digests[i] for i in own], n_bits)
            out[own] = ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
        return out


def build_runs(digest_bytes: int = 32, memtable_bytes: int = 64 << 20):
    """For mapInArrow over (doc_id, text as binary): kind 0, a row for each document; kind 1, the entries of sorted runs."""

    schema = pa.schema([("kind", pa.int32()), ("digest", pa.binary()), ("task", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        memtable: dict[bytes, dict[bytes, list]] = {}
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            entries = [(1, d, task, e[1], e[0], e[2]) for d in sorted(memtable) for e in memtable[d].values()]
            for i in range(0, len(entries), 50_000):
                yield out(entries[i : i + 50_000])
            memtable.clear()

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or b""
                digest = hashlib.sha256(text).digest()[:digest_bytes]
                rows.append((0, digest, task, seq, doc_id, 1))
                same = memtable.setdefault(digest, {})
                entry = same.get(text)  # compares bytes
                if entry is None:
                    same[text] = [doc_id, seq, 1]
                    held += len(text) + 200
                else:
                    entry[2] += 1
                    if doc_id is not None and (entry[0] is None or doc_id > entry[0]):
                        entry[0], entry[1] = doc_id, seq
                seq += 1
            if rows:
                yield out(rows)
            if held > memtable_bytes:
                yield from flushed()
                held = 0
        yield from flushed()

    return run


def merged_runs(most_bits: int):
    """For mapInArrow over entries (digest, task, seq, doc_id, n), in order of digest: kind 0, one entry for each digest, its largest row and how many entries it
    had; kind 1, the filter of the digests with several entries, with the first and last digest of the range."""
    schema = pa.schema([("kind", pa.int32()), ("digest", pa.binary()), ("task", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("entries", pa.int64()), ("last", pa.binary()), ("bits", pa.binary())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, now, rows, hits = None, None, [], []
        for batch in batches:
            for digest, task, seq, doc_id, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = (doc_id is not None, doc_id or 0, task, seq)
                if now is None or digest != now[0]:
                    if now is not None:
                        rows.append(now)
                    first = digest if first is None else first
                    now = [digest, row, n, 1]
                else:
                    now[1], now[2], now[3] = max(now[1], row), now[2] + n, now[3] + 1
                    if now[3] == 2:
                        hits.append(digest)
            if len(rows) > 50_000:
                yield out([(0, d, t, s, i if known else None, n, m, None, None) for d, (known, i, t, s), n, m in rows])
                rows = []
        if now is not None:
            rows.append(now)
            yield out([(0, d, t, s, i if known else None, n, m, None, None) for d, (known, i, t, s), n, m in rows])
            if hits:
                yield out([(1, first, None, None, None, None, None, now[0], made_filter(hits, most_bits))])

    return run


def hit_texts(filters: RunFilters, digest_bytes: int = 32):
    """For mapInArrow over (doc_id, text): each text, once a task and memtable, whose digest the filter of its run may hold."""
    schema = pa.schema([("digest", pa.binary()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            digests = [hashlib.sha256(t).digest()[:digest_bytes] for t in texts]
            new = []
            for i in np.flatnonzero(filters.may_hold(digests)):
                if seen.get(digests[i]) != texts[i]:
                    seen[digests[i]] = texts[i]
                    held += len(texts[i])
                    new.append(i)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in new], pa.binary()), pa.array([texts[i] for i in new], pa.binary())], schema=schema)
            if held > 32 << 20:
                seen, held = {}, 0

    return run


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, memtable_bytes: int = 64 << 20) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, digest (binary).

    Of equal texts the row with the largest doc_id stays. digest_bytes below 32 makes digests collide; results stay the same.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    out = slim.mapInArrow(build_runs(digest_bytes, memtable_bytes), "kind int, digest binary, task int, seq long, doc_id long, n long")
    path = f"{scratch.base}/runs"
    out.write.partitionBy("kind").parquet(path)
    both = spark.read.schema(out.schema).parquet(path)
    rows = both.where("kind = 0").drop("kind", "n")
    entries = both.where("kind = 1").select("digest", "task", "seq", "doc_id", "n")
    # Compaction. An entry stands for a text of a memtable, so a digest has few entries however many rows it has.
    dealt = entries.repartitionByRange("digest").sortWithinPartitions("digest", "task", "seq")
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = scratch.put(dealt.mapInArrow(merged_runs(MOST_BITS // ranges), "kind int, digest binary, task int, seq long, doc_id long, n long, entries long, last binary, bits binary"), "compacted")
    index = merged.where("kind = 0").select("digest", F.col("task").alias("keep_task"), F.col("seq").alias("keep_seq"), F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    filters = RunFilters([(bytes(r["digest"]), bytes(r["last"]), bytes(r["bits"])) for r in merged.where("kind = 1").select("digest", "last", "bits").toLocalIterator()])  # MOST_BITS / 8 bytes at most
    n_rows, done, clash = rows.count(), [], None
    if filters.runs:
        texts = slim.mapInArrow(hit_texts(filters, digest_bytes), "digest binary, text binary")
        clash = scratch.put(texts.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo != hi").select("digest"), "clash")
    if clash is not None and not clash.isEmpty():
        # Unequal texts under one digest: such rows are told apart by the text itself, equal rows by counting them.
        own = slim.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes)).join(clash, "digest")
        each = own.groupBy("digest", "text", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        each = scratch.put(each, "each")
        groups = each.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")).withColumnsRenamed({"digest": "d2", "text": "t2"})
        sized = each.join(groups, (F.col("digest") == F.col("d2")) & (F.col("text") == F.col("t2"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        done = [sized.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest")]
        rows, index = rows.join(clash, "digest", "left_anti"), index.join(clash, "digest", "left_anti")
    # a text may be that of a large share of all rows
    index = index.withColumn("rows", F.col("group_size"))
    found = looked_up(rows, index, "digest", "rows", n_rows)
    kept = (F.col("task") == F.col("keep_task")) & (F.col("seq") == F.col("keep_seq"))
    return reduce(DataFrame.unionByName, done, found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
