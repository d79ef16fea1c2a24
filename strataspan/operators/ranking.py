"""Exact lookup, nearest vectors, fusion of modes, decay and priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Rows and queries that meet in one task, the scores that it holds at once, and scores of a group whose largest one is looked at first.
BLOCK, PART, SCORES, GROUP = 32_768, 32_768, 2**21, 64
#: Half-lives and lifetimes by retention class (none: never), retention class by kind.
HALF_LIFE_MS = {"ephemeral-payload": 3 * DAY_MS, "conversation-source": 21 * DAY_MS, "derived-evidence": 14 * DAY_MS}
LIFETIME_MS = {"ephemeral-payload": 14 * DAY_MS, "conversation-source": 90 * DAY_MS, "derived-evidence": 30 * DAY_MS}
CLASS_OF_KIND = {"tool-result": "ephemeral-payload", "tool-argument": "ephemeral-payload", "decision-candidate": "derived-evidence", "fact-candidate": "derived-evidence", "manual": "durable-evidence"}


def by_name(values: dict, key: Column, other=None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(other))


def exact_score(exact: Column, coverage: Column, specificity: Column) -> Column:
    case = F.when(exact, 1.0).otherwise(0.72)
    return F.round(F.least(F.lit(1.0), 0.55 + 0.25 * case + 0.12 * coverage + 0.08 * specificity), 6)


def exact_lookup(anchors: DataFrame, asked: DataFrame) -> DataFrame:
    """Matches of asked (query_id, value) among anchors (document_id, value, specificity): exact ones, and for queries without any, folded ones."""
    first = asked.join(anchors, "value").select("query_id", "document_id", "value", "specificity", F.lit(True).alias("exact"))
    rest = asked.join(first.select("query_id").distinct(), "query_id", "left_anti").withColumn("folded", F.lower("value")).drop("value")
    second = rest.join(anchors.withColumn("folded", F.lower("value")), "folded").select("query_id", "document_id", "value", "specificity", F.lit(False).alias("exact"))
    both = first.unionByName(second)
    return both.select("query_id", "document_id", "value", "exact", exact_score(F.col("exact"), F.lit(1.0), F.col("specificity")).alias("score")).distinct()


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, least: float = -1.0, own: bool = False) -> DataFrame:
    """Exact cosine neighbours (query_id, rank, vec_id, score) of each query (id, v) among rows (id, v), the row of its own id excluded unless own.

    Vectors that are null, empty or all 0, or that hold a null, NaN or infinity, take no part; nor do rows without an id. Rows are dealt into blocks by hash and each block meets each part of the queries once, as matrix products of a few queries at a time (at most SCORES scores in memory); every block hands on k rows a query.
    """
    whole = F.col("id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows, queries = (d.select("id", "v").where(F.coalesce(whole, F.lit(False))) for d in (rows, queries))
    blocks, parts = max(8, -(-rows.count() // BLOCK)), max(1, -(-queries.count() // PART))
    left = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        m, q = np.stack(a["v"]).astype(np.float64), np.stack(b["v"]).astype(np.float64)
        m, q = m / np.linalg.norm(m, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
        ids, asked, some = a["id"].to_numpy(), b["id"].to_numpy(), max(1, SCORES // len(m))
        by_id = np.argsort(ids, kind="stable")
        lo, hi = (np.searchsorted(ids[by_id], asked, side) for side in ("left", "right"))
        pad = -len(m) % GROUP
        found = []
        for at in range(0, len(q), some):
            scores = q[at : at + some] @ m.T
            if not own:
                for i in np.flatnonzero(hi[at : at + some] > lo[at : at + some]):
                    scores[i, by_id[lo[at + i] : hi[at + i]]] = -np.inf
            # the k-th largest of the groups' largest scores is no more than the k-th best score; 1e-8 is more than rounding moves
            tops = np.pad(scores, ((0, 0), (0, pad)), constant_values=-np.inf).reshape(len(scores), -1, GROUP).max(axis=2)
            low = np.full(len(scores), least) if tops.shape[1] <= k else np.maximum(least, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k])
            row, other = np.nonzero((scores >= low[:, None] - 1e-8) & (scores > -np.inf))
            near = np.round(scores[row, other], 9)
            good = near >= least
            row, other, near = row[good], other[good], near[good]
            best = np.lexsort((ids[other], -near, row))
            row, other, near = row[best], other[best], near[best]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((asked[at + row[first]], ids[other[first]], near[first]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query_id", "vec_id", "score"), zip(*found, strict=True), strict=True)})

    some = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(best, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def fused(pool: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (query_id, mode, id, norm): dense ranks within a mode, 1 / (60 + rank) summed, blended with the normalized score
    by the best rank, and clamped so that no mode's own order is turned. Returns (query_id, id, fusion_score, fused_rank)."""
    once = pool.groupBy("query_id", "mode", "id").agg(F.max("norm").alias("norm"))
    ranked = once.withColumn("r", F.dense_rank().over(Window.partitionBy("query_id", "mode").orderBy(F.desc("norm"))))
    per = Window.partitionBy("query_id", "id")
    blended = ranked.withColumn("rrf", F.sum(1.0 / (60 + F.col("r"))).over(per)).withColumn("best", F.min("r").over(per)).withColumn("top", F.max("rrf").over(Window.partitionBy("query_id")))
    w = F.when(F.col("best") <= 3, 0.75).when(F.col("best") <= 10, 0.6).otherwise(0.4)
    mixed = blended.withColumn("blend", F.round(w * F.col("rrf") / F.col("top") + (1 - w) * F.col("norm"), 9))
    clamp = F.min("blend").over(Window.partitionBy("query_id", "mode").orderBy(F.desc("norm"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = mixed.withColumn("c", clamp).groupBy("query_id", "id").agg(F.round(F.max("c"), 6).alias("fusion_score"))
    return best.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), "id")))


def decay(age_ms: Column, retention: Column) -> Column:
    """2 to the power of minus age over half-life; future documents and classes without half-life keep 1."""
    half = by_name(HALF_LIFE_MS, retention)
    return F.coalesce(F.pow(F.lit(2.0), -F.greatest(F.lit(0), age_ms) / half), F.lit(1.0))


def count_scale(n: Column) -> Column:
    return F.log2(1 + F.least(n, F.lit(32))) / F.log2(F.lit(33.0))


def importance(decision: Column, pinned: Column, refs: Column, recalls: Column) -> Column:
    total = 0.06 * decision.cast("int") + 0.06 * pinned.cast("int") + 0.05 * count_scale(refs) + 0.05 * count_scale(recalls)
    return F.round(1 + F.least(F.lit(0.15), total), 6)


def demoted(pool: DataFrame, factors: DataFrame) -> DataFrame:
    """pool (query_id, mode, id, norm) with the norms multiplied by factors (id, factor), never above 1; then fused() ranks it anew."""
    met = pool.join(factors, "id", "left")
    return met.withColumn("norm", F.least(F.lit(1.0), F.round(F.col("norm") * F.coalesce("factor", F.lit(1.0)), 6))).drop("factor")


def tiered(exact: DataFrame, structural: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, tier, score, fusion_score): exact matches (query_id, id, score) come first, then structural ones, then the fused modes; of a document its best
    tier stays. score is what its mode says, fusion_score what puts it in order."""
    own = pool.groupBy("query_id", "id").agg(F.max("norm").alias("score"))
    parts = [
        exact.select("query_id", "id", F.lit(3).alias("tier"), "score", F.col("score").alias("fusion_score")),
        structural.select("query_id", "id", F.lit(2).alias("tier"), "score", F.col("score").alias("fusion_score")),
        fused(pool).join(own, ["query_id", "id"]).select("query_id", "id", F.lit(1).alias("tier"), "score", "fusion_score"),
    ]
    one = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("query_id", "id").agg(F.max(F.struct("tier", "fusion_score", "score")).alias("b"))
    flat = one.select("query_id", "id", "b.tier", "b.score", "b.fusion_score")
    w = Window.partitionBy("query_id").orderBy(F.desc("tier"), F.desc("fusion_score"), "id")
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "tier", "score", "fusion_score")


def margins(results: DataFrame) -> DataFrame:
    """results (query_id, mode, id, norm) with margin, to the next one of the mode, or to nothing."""
    w = Window.partitionBy("query_id", "mode").orderBy(F.desc("norm"), "id")
    return results.withColumn("margin", F.round(F.col("norm") - F.lead("norm", 1, 0.0).over(w), 6))


def evidence_margins(results: DataFrame) -> DataFrame:
    """results (query_id, mode, rank, id, root, norm) with evidence_margin, to the next one of the mode that has another root of evidence."""
    w = Window.partitionBy("query_id", "mode").orderBy("rank")
    run = results.withColumn("_new", F.coalesce((F.lag("root").over(w) != F.col("root")).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    firsts = run.groupBy("query_id", "mode", "_run").agg(F.min_by("norm", "rank").alias("_norm"))
    nxt = firsts.select("query_id", "mode", (F.col("_run") - 1).alias("_run"), "_norm")
    return run.join(nxt, ["query_id", "mode", "_run"], "left").withColumn("evidence_margin", F.round(F.col("norm") - F.coalesce("_norm", F.lit(0.0)), 6)).drop("_new", "_run", "_norm")


def relevance_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "moderate").when(score >= 0.2, "some").otherwise("low")
