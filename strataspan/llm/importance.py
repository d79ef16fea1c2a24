"""Importance resampling towards a target distribution, without exploding a document to be scored.

Words are hashed into buckets once and each document's array of buckets is stored. Counts of the buckets over all documents and over the target texts give each bucket a
gain, the scaled logarithm of how much likelier it is in the target; a document's weight is the mean gain of its features, which an aggregate over the stored array reads from
one literal array of all gains. Only the totals of the buckets are shuffled for that, a row for each bucket and task. Gumbel noise from a hash of the id turns the highest
scores into a weighted draw without replacement. Ranks need no sort of all documents: counts by score, summed by cells of scores and then within a cell, say how many documents
stand above each score, and only the documents at drawn scores are numbered, each score on its own.

Null texts have no words; a text without features has weight 0. Documents of fewer than least_words words are scored and never drawn. A null doc_id hashes as an empty one and
comes last among equal scores. Repeated rows are documents of their own; rows equal in score and id have adjoining ranks. An empty table gives an empty one; without target
texts the gains compare with a flat distribution. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspan.llm.shared import Scratch

#: Words: digits, letters of a to z after lower-casing A to Z, and all beyond ASCII.
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores of a cell; weights and noise are bounded by logarithms of 64-bit counts, so there are some 210,000 scores and 3,300 cells at most.
CELL = 64


def lower_words(text: Column) -> Column:
    """The words of a text with A to Z, and no other letter, in lower case."""
    ascii_only = lambda w: F.octet_length(w) == F.char_length(w)
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RAW_WORD), F.lit(0)), lambda w: F.when(ascii_only(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def features(words: Column, longest: int) -> Column:
    """All runs of 1 to longest consecutive words, joined by one space."""
    def of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1))), lambda i: i + (n - 1) <= F.size(words))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return words if longest == 1 else F.concat(words, *[of(n) for n in range(2, longest + 1)])


def bucketed(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """texts with n_words and buckets, an array with the bucket of each feature, in place of text."""
    words = texts.withColumn("_words", lower_words(F.col("text"))).drop("text")
    hashed = F.transform(features(F.col("_words"), longest), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))
    return words.withColumns({"n_words": F.size("_words"), "buckets": hashed}).drop("_words")


def bucket_counts(hashed: DataFrame) -> DataFrame:
    """(bucket, n): pre-aggregated in each task, so a row for each bucket and task is shuffled."""
    return hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), from bucket counts (bucket, n) of the source and of the target."""
    spark = source.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    filled = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    sums = filled.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    rows = filled.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()  # a row for each bucket
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise, scaled by 1000 and floored, from the first 32 bits of the SHA-256 of seed:id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(hashed: DataFrame, gain: list[int]) -> DataFrame:
    """hashed with n_features and weight, the floored mean of the gains, in place of buckets."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    sums = hashed.withColumns({"n_features": F.size("buckets").cast("long"), "_sum": total}).drop("buckets")
    floored = ((F.col("_sum") - F.pmod("_sum", "n_features")) / F.col("n_features")).cast("long")
    return sums.withColumn("weight", F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(floored)).drop("_sum")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored (doc_id, n_words, score) with rank: 1, 2, ... by falling score, then by id, of the given percentage of the documents that have enough words; else null.

    scored is read three times and should be stored.
    """
    able = scored.where(F.col("n_words") >= least_words)
    per = able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.floor(F.col("score") / CELL))
    cells = per.groupBy("cell").agg(F.sum("n").alias("n"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    starts = cells.select("cell", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("start"), F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) * percent / 100).alias("take"))
    within = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = per.join(F.broadcast(starts), "cell").select("score", "take", (F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"))
    drawn = F.broadcast(before.where("before < take"))
    met = scored.join(drawn, "score", "left")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    some = met.where((F.col("n_words") >= least_words) & F.col("take").isNotNull()).withColumn("rank", F.when(place <= F.col("take"), place).cast("long"))
    rest = met.where((F.col("n_words") < least_words) | F.col("take").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return some.unionByName(rest).drop("take", "before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, longest: int = 1, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text), drawn towards target (text)."""
    scratch = Scratch(docs.sparkSession, "importance")
    hashed = scratch.put(bucketed(docs.select(F.col("doc_id").cast("long"), "text"), buckets, longest), "buckets")
    gain = gains(bucket_counts(hashed), bucket_counts(bucketed(target.select("text"), buckets, longest)), buckets)
    weights = weighed(hashed, gain)
    scored = scratch.put(weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    scratch.drop(hashed)
    return ranked(scored, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target).drop("n_words")


#: The checksum is worked out over the bytes of each distinct word; its table of 256 entries by rule.
OP13_SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (
       SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
e AS (SELECT uid, unnest(w) AS f FROM d),
v AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM e UNION SELECT f FROM q)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
        lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM e JOIN b USING (f) GROUP BY bucket),
u AS (SELECT bucket, count(*) AS t FROM q JOIN b USING (f) GROUP BY bucket),
g AS (SELECT i AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM u), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN u ON u.bucket = i),
m AS (SELECT uid, sum(gain) AS total FROM e JOIN b USING (f) JOIN g USING (bucket) GROUP BY uid),
w AS (SELECT uid, doc_id, len(w) AS n_features, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE floor(total::DOUBLE / len(w)) END AS BIGINT) AS weight FROM d LEFT JOIN m USING (uid)),
k AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score FROM w),
o AS (SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM k WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN CAST(rank AS BIGINT) END AS rank FROM k LEFT JOIN o USING (uid)
"""
