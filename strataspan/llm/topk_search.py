"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows and queries are sparse: parallel arrays of terms and integer weights. Equal rows are counted first; then rows are dealt into blocks of a bounded number of
terms and queries into blocks of bounded number; each pair of blocks is one task, which turns its rows into postings by term, lets every query scatter its
weighted postings into a dense array of scores, keeps the k best by partition selection, and hands on at most k rows a query. A last
window merges these. Nothing is approximate and no row is skipped.

Vectors that are null or hold a null, NaN or infinity, and rows without an id, take no part; an empty vector scores 0 with all. Each row with another id is a
candidate, repeated rows as often as they come; a query's own id is none of its candidates. Queries that repeat id and vector are one query; different vectors of one
id are queries of their own, each with its k best. Ties go to the smaller id. Vectors of different lengths are compared over the terms that both have. Scores
beyond 64 bits are cut to the nearest 64-bit number. Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Terms of all rows of a block together and queries of a block at most, about; blocks at least, so that a small table is spread as well.
BLOCK_TERMS, BLOCK_QUERIES, LEAST_BLOCKS = 1 << 22, 4_096, 24


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(id, terms, weights) of dense vectors (vec_id, embedding): weight floor(scale * x) at each term whose weight isn't 0."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("dense")).select("id", *_sparse())


def _sparse() -> list[F.Column]:
    both = F.filter(F.transform("dense", lambda w, i: F.struct(i.alias("t"), w.alias("w"))), lambda s: s["w"] != 0)
    return [F.transform(both, lambda s: s["t"].cast("int")).alias("terms"), F.transform(both, lambda s: s["w"].cast("long")).alias("weights")]


def _best(k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        cols = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            ids, copies = rows["id"].to_numpy(np.int64), np.minimum(rows["copies"].to_numpy(np.int64), k)
            lens = rows["terms"].map(len).to_numpy()
            doc = np.repeat(np.arange(len(ids)), lens)
            term = np.concatenate(rows["terms"].to_list()) if lens.sum() else np.empty(0, np.int32)
            weight = np.concatenate(rows["weights"].to_list()) if lens.sum() else np.empty(0, np.int64)
            asked = np.concatenate([[0], *queries["weights"].to_list()])
            # 64 bits hold every score, or else Python's numbers do
            kind = np.int64 if float(np.abs(weight.astype(float)).max(initial=0)) * float(np.abs(asked.astype(float)).max()) * max(1, lens.max()) < 2.0**62 else object
            by = np.argsort(term, kind="stable")
            names, first = np.unique(term[by], return_index=True)
            doc, weight, ends = doc[by], weight[by].astype(kind), np.append(first[1:], len(by))[: len(names)]  # none, if all vectors are zero
            postings = {int(t): (doc[a:b], weight[a:b]) for t, a, b in zip(names, first, ends, strict=True)}
            for qid, query, terms, weights in zip(queries["id"].to_numpy(np.int64), queries["query"], queries["terms"], queries["weights"], strict=True):
                scores = np.zeros(len(ids), dtype=kind)
                for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                    if (p := postings.get(t)) is not None:
                        if len(p[0]) == len(ids):
                            scores += p[1] * w
                        else:
                            scores[p[0]] += p[1] * w
                if kind is object:
                    scores = np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores], dtype=np.int64)
                other = np.flatnonzero(ids != qid)
                if len(other) > k:
                    own = scores[other]
                    least = np.partition(own, len(own) - k)[len(own) - k]
                    other = other[own >= least]
                order = other[np.lexsort((ids[other], ~scores[other]))][:k]  # ~ turns the order round without overflow
                order = np.repeat(order, copies[order])[:k]
                cols["query_id"].append(np.full(len(order), qid))
                cols["query"].append(np.full(len(order), query))
                cols["vec_id"].append(ids[order])
                cols["score"].append(scores[order])
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in cols.items()})

    return run


def topk(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best rows of each query by integer inner product: query_id, rank, vec_id, score. Both inputs have (id, terms, weights)."""
    rows = rows.groupBy("id", "terms", "weights").agg(F.count(F.lit(1)).alias("copies"))
    queries = queries.select("id", "terms", "weights").distinct().withColumn("query", F.xxhash64("id", "terms", "weights"))
    n_terms = rows.agg(F.sum(F.size("terms") + 1)).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-n_terms // BLOCK_TERMS))
    parts = max(1, -(-queries.count() // BLOCK_QUERIES))
    # A row goes to one block, whatever its id: rows that share an id stay within a block's size.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "terms", "weights"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.withColumn("part", F.pmod(F.col("query"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    some = dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(_best(k), "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc("vec_id"))
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return topk(rows, rows.where("id % 100 = 0"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.e AS query, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id != c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
