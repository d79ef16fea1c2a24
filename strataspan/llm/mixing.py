"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key; documents are ordered by key within their source. Sizes are summed by (source, leading digits of
the key), these sums are accumulated along each source, and a window within one such cell gives every document the words before it. A
source's budget is then cut exactly: the first pass over the source takes words up to the budget, a second pass what is left of it.
No window spans a source, so a source that holds most rows is spread over all tasks.

Null texts have size 0 and are never taken; a null source is a source of its own, the last one; a null doc_id hashes as an empty one.
Repeated rows are taken one by one. With no words at all every target is 0. Extra columns are not read, or are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspan.llm.shared import WORD, Scratch, n_words

#: Hexadecimal digits of the key that name a cell of a source, at least; and rows of a cell, about, if one source holds them all.
LEAST_DIGITS, CELL_ROWS = 3, 50_000


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Targets of the sources in (sk, source, size): proportional to the weights, which repeat along the sources in code point order, null
    last; capped at most times the size, the excess going to the others by weight. Column target is added.

    Filling by increasing cap per weight reaches the end of that sharing in one pass: a source is capped if its cap is within its
    share of what the sources before it leave. One row a source, so the windows here are as small as the list of sources.
    """
    n = len(weights)
    at = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    ranked = sizes.withColumn("rank", F.row_number().over(at) - 1)
    weighed = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("size"))
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = Window.partitionBy(F.lit(0))
    level = weighed.withColumn("level", (F.lit(float(share)) * F.sum("size").over(whole) - before) / rest).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    line = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return level.withColumn("line", line).withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("line"))).select("sk", "source", "size", "target")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and carried_x for each column x in carry: a row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "mixing")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(F.col("doc_id").cast("long"), "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("sk"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    n, digits = docs.count(), LEAST_DIGITS
    while 16**digits * CELL_ROWS < n:
        digits += 1
    rows = rows.withColumn("cell", F.substring("key", 1, digits))
    cells = scratch.put(rows.groupBy("sk", "source", "cell").agg(F.sum("size").alias("words")), "cells")
    sizes = cells.groupBy("sk", "source").agg(F.sum("words").alias("size"))
    targets = source_targets(sizes, weights, share, most)
    along = Window.partitionBy("sk").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("sk", "cell", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("start"))
    plan = scratch.put(starts.join(targets.select("sk", F.col("size").alias("source_size"), "target"), "sk"), "plan")
    scratch.drop(cells)
    ties = [F.col("key"), F.col("doc_id"), F.col("size"), *[F.col(f"carried_{c}") for c in carry]]
    within = Window.partitionBy("sk", "cell").orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(plan, ["sk", "cell"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor("target")

    def from_pass(i: int) -> F.Column:
        return F.least(F.col("size"), F.greatest(F.lit(0), budget - i * F.col("source_size") - F.col("before")))

    passes = int(-(-most // 1))
    taken = from_pass(0)
    for i in range(1, passes):
        taken = taken + from_pass(i)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *[f"carried_{c}" for c in carry])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass over a document, the one at a source's cut ending at the cut."""
    others = [c for c in docs.columns if c not in ("doc_id", "source")]
    taken = mix(docs, carry=others, **options)
    full, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = taken.where("taken > 0").withColumn("rest", rest).withColumn("last", (full + F.when(rest > 0, 1).otherwise(0)).cast("int"))
    each = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), "last")))
    text = F.col("carried_text")
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.when((F.col("rest") > 0) & (F.col("copy") == F.col("last")), F.array_join(F.slice(words, F.lit(1), F.col("rest").cast("int")), "")).otherwise(text)
    done = each.withColumn("carried_text", cut)
    made = {"text": F.col("carried_text"), "n_chars": F.length("carried_text").cast("long"), "doc_id": F.col("doc_id"), "source": F.col("source")}
    return done.select(*[made.get(c, F.col(f"carried_{c}")).alias(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN cap <= w * level THEN cap ELSE w * max(CASE WHEN cap > w * level THEN level END) OVER () END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(size, greatest(0, CAST(floor(target) AS BIGINT) - before)) + least(size, greatest(0, CAST(floor(target) AS BIGINT) - source_size - before)) AS BIGINT) AS taken
FROM p
"""
