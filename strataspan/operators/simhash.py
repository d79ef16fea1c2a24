"""64-bit SimHash signatures over term frequencies, and similar pairs by permuted tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.functions.text import terms


def signatures(docs: DataFrame, *keys: str) -> DataFrame:
    """(document_id, keys, token_count, simhash, status); keys may name further columns, as the version. Each bit is the sign of the sum of term frequencies over the terms' fingerprints.

    Each occurrence votes by itself, so no row of a term is shuffled. Votes for a bit are counted, those of bits b and b + 32 in the halves of one number, in one hash aggregation, map-side first: a row for each document and task is shuffled.
    """
    own = ["document_id", *keys]
    print_ = F.conv(F.substring(F.sha1(F.col("term").cast("binary")), 1, 16), 16, -10).cast("long")
    votes = docs.select(*own, F.explode_outer(terms("text")).alias("term")).select(*own, print_.alias("fp"))
    sums = votes.groupBy(*own).agg(F.count("fp").alias("token_count"), *[F.sum(F.shiftright("fp", b).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"b{b}") for b in range(32)])
    ones = [F.col(f"b{b}").bitwiseAND(F.lit((1 << 32) - 1)) for b in range(32)] + [F.shiftrightunsigned(f"b{b}", 32) for b in range(32)]
    bits = [F.when(2 * n > F.col("token_count"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for b, n in enumerate(ones)]
    out = bits[0]
    for x in bits[1:]:
        out = out.bitwiseOR(x)
    return sums.select(*own, "token_count", out.alias("simhash"), F.when(F.col("token_count") == 0, "empty").otherwise("complete").alias("status"))


def tables(most: int) -> list[int]:
    """Masks of the tables by which signatures within most bits meet: the 64 bits in most + 3 blocks, a mask for each choice of three. Bits that differ lie in most blocks at most, so three are equal."""
    edges = [round(64 * i / (most + 3)) for i in range(most + 4)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def similar_pairs(sigs: DataFrame, most: int = 3) -> DataFrame:
    """(left_simhash, right_simhash, distance) of different complete signatures within most bits, each once.

    Up to three bits, keys are three blocks of six, 32 bits on average, in 20 tables, so none is missed: of 10**9 signatures that are alike by chance only, one meets about 20 * 10**9 / 2**32, under 5, others,
    where bands of 16 bits would bring 61,000. A pair counts in its first table, so nothing is made distinct afterwards. Documents with equal signatures are one row here; their members are in sigs.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in tables(most)]
    one = sigs.where("status = 'complete'").select("simhash").distinct()
    keyed = one.select("simhash", F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))
    left, right = keyed.withColumnRenamed("simhash", "l"), keyed.withColumnRenamed("simhash", "r")
    differ = F.col("l").bitwiseXOR(F.col("r"))
    first = F.array_position(F.array(*[differ.bitwiseAND(F.lit(m)) == 0 for m in masks]), True) - 1
    # by a shuffle: sizes are guessed as if a signature had one key, so that a side of 20 keys each would be broadcast and held in the driver
    near = left.join(right.hint("merge"), ["table", "key"]).where("l < r").withColumn("distance", F.bit_count(differ)).where((F.col("distance") <= most) & (first == F.col("table")))
    return near.select(F.col("l").alias("left_simhash"), F.col("r").alias("right_simhash"), F.col("distance").cast("long"))


def greedy_representatives(ranked: DataFrame, most: int = 3) -> DataFrame:
    """Near-duplicate collapse of one result page (query_id, rank, simhash; at most a hundred rows a query): representative rank of each row."""
    pages = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "simhash"))).alias("rows"))

    def step(acc, x):
        near = F.filter(acc, lambda r: F.bit_count(r["simhash"].bitwiseXOR(x["simhash"])) <= most)
        own = F.filter(near, lambda r: r["rank"] == r["of"])
        return F.concat(acc, F.array(F.struct(x["rank"].alias("rank"), x["simhash"].alias("simhash"), F.coalesce(F.get(own, F.lit(0))["of"], x["rank"]).alias("of"))))

    start = F.array().cast("array<struct<rank:int,simhash:bigint,of:int>>")
    done = pages.select("query_id", F.explode(F.aggregate("rows", start, step)).alias("r"))
    return done.select("query_id", "r.rank", F.col("r.of").alias("representative"))
