"""A semantic index: spans of documents, vectors from a pluggable embedder, exact search by cosine with a threshold, lists by centroid that a search probes, maintenance, and reranking.

An embedder is a function from a list of texts to a matrix, given by name of a factory so that every Python worker makes its own. No model ships with the library; the
default hashes words, which is enough to test everything around it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspan.functions import text as tx
from strataspan.functions.batches import SLICE, map_slices

#: Least cosine of a hit; rebuild from this share of dead entries and so many entries; candidates that are reranked.
LEAST_COSINE, DEAD_RATIO, LEAST_ENTRIES, RERANKED = 0.35, 0.25, 1_000, 40
SPAN_TOKENS, SPAN_OVERLAP, DIMENSIONS = 160, 24, 256
#: Spans that centroids are fitted on at most; spans and queries that meet in one task; lists that a query looks into first.
SAMPLE, BLOCK, PART, PROBES = 20_000, 50_000, 4_096, 8


def hashed_words() -> Callable[[list[str]], np.ndarray]:
    """An embedder: every distinct stemmed word adds one signed dimension."""
    memo: dict[str, list[tuple[str, int, int]]] = {}

    def of(word: str) -> list[tuple[str, int, int]]:
        if word not in memo:
            if len(memo) >= 100_000:
                memo.clear()
            hashes = [(t, int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")) for t, _ in tx.analysed(word)]
            memo[word] = [(t, h % DIMENSIONS, 1 if h >> 63 else -1) for t, h in hashes]
        return memo[word]

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSIONS))
        for row, text in zip(out, texts, strict=True):
            for _, i, sign in {x for w in set(tx._WORD.findall(text)) for x in of(w)}:
                row[i] += sign
        return out

    return embed


def spans(text: str, size: int = SPAN_TOKENS, overlap: int = SPAN_OVERLAP) -> list[tuple[int, int, int]]:
    """(ordinal, start, end) in UTF-8 bytes: token spans with overlap, which cover the text."""
    return tx.windows(text, size, overlap / size)


def indexed(documents: DataFrame, embedder: Callable = hashed_words) -> DataFrame:
    """(project, document_id, version, session_id, ordinal, start_byte, end_byte, vector) of documents; spans without any word have no vector and are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = embedder()
        for b in batches:
            rows, texts = [], []
            for p, d, v, s, text in zip(b["project"], b["document_id"], b["version"], b["session_id"], b["text"], strict=True):
                raw = (text or "").encode()
                for i, start, end in spans(text or ""):
                    rows.append((p, d, v, s, i, start, end))
                    texts.append(raw[start:end].decode())
            for at in range(0, len(rows), 512):
                made = embed(texts[at : at + 512])
                norm = np.linalg.norm(made, axis=1)
                out = pd.DataFrame(rows[at : at + 512], columns=["project", "document_id", "version", "session_id", "ordinal", "start_byte", "end_byte"])
                out["vector"] = [(m / n).tolist() if n else None for m, n in zip(made, norm, strict=True)]
                yield out[out["vector"].notna()]

    slim = documents.select("project", F.col("document_id").cast("long"), F.col("version").cast("int"), "session_id", "text")
    return map_slices(slim, run, "project string, document_id long, version int, session_id string, ordinal int, start_byte long, end_byte long, vector array<double>")


def embedded(queries: DataFrame, embedder: Callable = hashed_words) -> DataFrame:
    """(query_id, v) of queries (query_id, text): a vector of each whole text, however long it is; zeros where it has no word."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = embedder()
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            made = embed([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.tolist(), pa.list_(pa.float64()))], names=["query_id", "v"])

    return queries.select("query_id", "text").mapInArrow(run, f"query_id {kind}, v array<double>")


def search(index: DataFrame, queries: DataFrame, limit: int = 10, least: float = LEAST_COSINE) -> DataFrame:
    """(query_id, rank, document_id, version, ordinal, start_byte, end_byte, score): the best 3 * limit documents of each query (query_id, v), by their best span, at least so
    similar. Up to PART queries are a page that every task gets, so that spans stay where they are and are made once; of more queries, parts meet blocks of spans once. Either way as matrix products, and no document is
    lost to the spans of another."""
    page = _asked(queries).limit(PART + 1).collect()  # a page: PART + 1 queries at most
    if len(page) <= PART:
        return _ranked(_best_of_page(index, page, queries.schema["query_id"].dataType.simpleString(), 3 * limit, least), 3 * limit)
    return _ranked(_best_documents(index.withColumn("list", F.lit(0)), _asked(queries).withColumn("list", F.lit(0)), 3 * limit, least), 3 * limit)


def _asked(queries: DataFrame) -> DataFrame:
    """Queries with a vector that has a direction."""
    whole = F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return queries.select("query_id", "v").where("query_id IS NOT NULL").where(F.coalesce(whole, F.lit(False)))


def _best_documents(rows: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, document_id, version, ordinal, start_byte, end_byte, score): for each query (query_id, v, list) the k best documents of each block of the rows of its list, each by its best span there. A document's best
    span is in some block, where fewer than k documents can be before it, so the k best of all are among these. Lists are dealt into blocks of BLOCK spans, queries into parts of PART."""
    spans = "document_id long, version int, ordinal int, start_byte long, end_byte long"
    names = [x.split(" ")[0] for x in spans.split(", ")]
    sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    parts = max(1, -(-queries.count() // PART))
    left = rows.select("list", *names, "vector").join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("document_id", "version", "ordinal"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.join(sizes, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))

    def best(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            m, q = np.stack(a["vector"]).astype(np.float64), np.stack(b["v"]).astype(np.float64)
            doc, version, ordinal = (a[c].to_numpy() for c in ("document_id", "version", "ordinal"))
            code = a.groupby(["document_id", "version"], sort=False).ngroup().to_numpy()
            for qid, v in zip(b["query_id"], q / np.linalg.norm(q, axis=1, keepdims=True), strict=True):
                score = np.round(m @ v, 6)
                near = np.flatnonzero(score >= least)
                near = near[np.lexsort((ordinal[near], version[near], doc[near], -score[near]))]
                near = near[np.sort(np.unique(code[near], return_index=True)[1])][:k]
                out.append(a.iloc[near][names].assign(query_id=qid, score=score[near]))
        return pd.concat(out)[["query_id", *names, "score"]] if out else pd.DataFrame({c: [] for c in ("query_id", *names, "score")})

    kind = queries.schema["query_id"].dataType.simpleString()
    return left.groupBy("list", "block", "part").cogroup(right.select("list", "block", "part", "query_id", "v").groupBy("list", "block", "part")).applyInPandas(best, f"query_id {kind}, {spans}, score double")


def _best_of_page(rows: DataFrame, page: list, kind: str, k: int, least: float) -> DataFrame:
    """_best_documents() for a page of queries: the k best documents of each slice of the rows."""
    names = ["document_id", "version", "ordinal", "start_byte", "end_byte"]
    asked = [r["query_id"] for r in page]
    q = np.array([r["v"] for r in page], dtype=np.float64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = q / np.linalg.norm(q, axis=1, keepdims=True) if len(q) else q
        for a in frames:
            out, m = [], np.stack(a["vector"]).astype(np.float64)
            doc, version, ordinal = (a[c].to_numpy() for c in ("document_id", "version", "ordinal"))
            code = a.groupby(["document_id", "version"], sort=False).ngroup().to_numpy()
            for n, qid in enumerate(asked):
                score = np.round(m @ unit[n], 6)
                near = np.flatnonzero(score >= least)
                if len(near):
                    near = near[np.lexsort((ordinal[near], version[near], doc[near], -score[near]))]
                    near = near[np.sort(np.unique(code[near], return_index=True)[1])][:k]
                    out.append(a.iloc[near][names].assign(query_id=qid, score=score[near]))
            if out:
                yield pd.concat(out)[["query_id", *names, "score"]]

    slim = rows.select(*names, "vector")
    return map_slices(slim, run, f"query_id {kind}, document_id long, version int, ordinal int, start_byte long, end_byte long, score double", 4_096)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "document_id", "version").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("before"), "start_byte", "end_byte")).alias("b"))
    flat = best.select("query_id", "document_id", "version", (-F.col("b.before")).alias("ordinal"), "b.start_byte", "b.end_byte", "b.score")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "version")
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "document_id", "version", "ordinal", "start_byte", "end_byte", "score")


def fitted(index: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = 15) -> np.ndarray:
    """Centroids (lists, dimensions) of spans, by spherical k-means in the driver over the sample spans of least hash: a bounded sample, the same in every run. The first ones are spread: each is the span
    that is least like those before."""
    few = index.select("vector", F.xxhash64("document_id", "version", "ordinal").alias("h"), "document_id", "ordinal").orderBy("h", "document_id", "ordinal").limit(sample)
    got = [r["vector"] for r in few.select("vector").collect()]  # sample rows at most
    if not got:
        return np.zeros((0, 0))
    x = np.array(got)
    at, most = [0], x @ x[0]
    while len(at) < min(lists, len(x)) and most.min() < 1 - 1e-9:
        at.append(int(most.argmin()))
        most = np.maximum(most, x @ x[at[-1]])
    centres = x[at]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def listed(index: DataFrame, centres: np.ndarray) -> DataFrame:
    """index with list, the number of the nearest centroid; every row has one. Centroids are lists * dimensions numbers, which every task gets."""
    names = list(index.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(list=(np.stack(b["vector"]) @ centres.T).argmax(axis=1).astype("int32") if len(b) else np.zeros(0, "int32"))[[*names, "list"]]

    return index.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema) + ", list int")


def probes(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """(query_id, v, list, nth): all lists of each query, nearest first from 1."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, v, int(c), n + 1) for q, v in zip(b["query_id"], b["v"], strict=True) for n, c in enumerate(np.argsort(-(centres @ v), kind="stable"))]
            yield pd.DataFrame(rows, columns=["query_id", "v", "list", "nth"])

    return _asked(queries).mapInPandas(run, f"query_id {kind}, v array<double>, list int, nth int")


def probed(index: DataFrame, centres: np.ndarray, queries: DataFrame, limit: int = 10, least: float = LEAST_COSINE, n_probe: int = PROBES) -> DataFrame:
    """search() over listed(): the n_probe nearest lists of a query first; a query that finds fewer than 3 * limit documents there goes on to all other lists, so it either has that many or what search() gives.

    The index may be filtered before (a project, live documents): a scope is part of the scan, not taken off a finished page."""
    want, all_ = 3 * limit, probes(queries, centres)
    first = _ranked(_best_documents(index, all_.where(F.col("nth") <= n_probe).drop("nth"), want, least), want)
    n = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = all_.where(F.col("nth") > n_probe).join(n, "query_id", "left").where(F.coalesce("n", F.lit(0)) < want).drop("n", "nth")
    return _ranked(first.drop("rank").unionByName(_best_documents(index, short, want, least)), want)


def maintenance(index: DataFrame, live: DataFrame) -> DataFrame:
    """(project, entries, dead, rebuild): entries of documents that aren't live (document_id, version), and whether a project's vectors should be written anew."""
    alive = live.select("document_id", "version").distinct().withColumn("_live", F.lit(True))
    per = index.join(alive, ["document_id", "version"], "left").groupBy("project").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("_live").isNull()).alias("dead"))
    return per.withColumn("rebuild", (F.col("entries") >= LEAST_ENTRIES) & (F.col("dead") >= DEAD_RATIO * F.col("entries")))


def rebuilt(index: DataFrame, live: DataFrame) -> DataFrame:
    return index.join(live.select("document_id", "version").distinct(), ["document_id", "version"], "left_semi")


def without_project(index: DataFrame, project: str) -> DataFrame:
    return index.where(F.col("project") != project)


def reranked(results: DataFrame, scores: DataFrame, most: int = RERANKED) -> DataFrame:
    """results (query_id, tier, rank, document_id) with new_rank: tier-one rows among the first most are put in order of their scores (query_id, document_id, score), which leaves
    rows without one behind them in their old order; other rows keep their place. Without any score for a query nothing changes."""
    met = results.join(scores.select("query_id", "document_id", F.col("score").alias("_s")), ["query_id", "document_id"], "left")
    some = F.max(F.col("_s").isNotNull()).over(Window.partitionBy("query_id"))
    mine = F.coalesce((F.col("tier") == 1) & (F.col("rank") <= most) & some, F.lit(False))
    order = Window.partitionBy("query_id", "_m")
    placed = met.withColumn("_m", mine).withColumn("_k", F.row_number().over(order.orderBy("rank"))).withColumn("_n", F.row_number().over(order.orderBy(F.desc_nulls_last("_s"), "rank")))
    # the n-th best takes the n-th place among the rows that move
    places = placed.where("_m").select("query_id", F.col("_k").alias("_n"), F.col("rank").alias("_place"))
    return placed.join(places, ["query_id", "_n"], "left").select("query_id", "document_id", "tier", "rank", F.when(F.col("_m"), F.col("_place")).otherwise(F.col("rank")).alias("new_rank"))
