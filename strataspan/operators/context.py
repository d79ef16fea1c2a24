"""Boosts by context, dependents, decision lookup along a lineage, message budgets and rotation of a conversation window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounded multipliers of a score.
CONTEXT_BOOST, WORKING_SET_BOOST = 1.08, 1.12


def context_terms(turns: DataFrame, last: int = 6, most: int = 16) -> DataFrame:
    """(conv_id, rank, term): terms of each conversation's last turns (conv_id, turn_group, terms), by rarity among these turns, then frequency, then term."""
    recent = turns.withColumn("back", F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.desc("turn_group")))).where(F.col("back") <= last)
    n = recent.groupBy("conv_id").agg(F.count_distinct("turn_group").alias("g"))
    words = recent.select("conv_id", "turn_group", F.explode("terms").alias("term")).groupBy("conv_id", "term").agg(F.count_distinct("turn_group").alias("df"), F.count(F.lit(1)).alias("tf"))
    scored = words.join(n, "conv_id").withColumn("idf", F.round(F.log((F.col("g") + 1) / (F.col("df") + 1)) + 1, 9))
    order = Window.partitionBy("conv_id").orderBy(F.desc("idf"), F.desc("tf"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("conv_id", "rank", "term")


def boosted(pool: DataFrame, matched: DataFrame, factor: float) -> DataFrame:
    """pool (query_id, id, norm) with the norm of matched (query_id, id) multiplied, at most 1."""
    hit = matched.select("query_id", "id").distinct().withColumn("_hit", F.lit(True))
    return pool.join(hit, ["query_id", "id"], "left").withColumn("norm", F.when(F.col("_hit"), F.least(F.lit(1.0), F.round(F.col("norm") * factor, 6))).otherwise(F.col("norm"))).drop("_hit")


def dependents(targets: DataFrame, documents: DataFrame, sources: DataFrame, citations: DataFrame, links: DataFrame, most: int = 10) -> DataFrame:
    """(target_id, n, first): documents created after a target that share a source key, cite it, or supersede it; their number and the first few.

    sources (document_id, source_key), citations (document_id, cited_id), links (id, supersedes). A target of one source key doesn't meet the documents of the key: they are numbered in order of their time once,
    so that how many are later is a difference, and the first ones are those of the next numbers. What cites or supersedes it counts besides where it isn't of the key. Only targets of several keys meet
    the documents of each, as a document that shares two counts once.
    """
    times = documents.select("document_id", "created_at")
    own = times.select(F.col("document_id").alias("target_id"), F.col("created_at").alias("t"))
    keyed = sources.where("source_key IS NOT NULL").distinct()
    mine = targets.select(F.col("document_id").alias("target_id")).distinct().join(keyed.withColumnRenamed("document_id", "target_id"), "target_id")
    keys = mine.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_keys"), F.min("source_key").alias("source_key"))
    one = keys.where("n_keys = 1").select("target_id", "source_key")
    in_key = Window.partitionBy("source_key")
    timed = keyed.join(times.where("created_at IS NOT NULL"), "document_id")
    placed = timed.withColumn("place", F.row_number().over(in_key.orderBy("created_at", "document_id"))).withColumn("upto", F.count(F.lit(1)).over(in_key.orderBy("created_at"))).withColumn("all", F.count(F.lit(1)).over(in_key))
    at = placed.select("source_key", F.col("document_id").alias("target_id"), "upto", F.col("all"), "created_at").join(one, ["target_id", "source_key"])
    counts = at.select("target_id", (F.col("all") - F.col("upto")).alias("n_shared"))
    next_ = at.select("target_id", "source_key", F.explode(F.sequence(F.col("upto") + 1, F.col("upto") + most)).alias("place"))
    nearest = next_.join(placed.select("source_key", "place", "document_id", "created_at"), ["source_key", "place"]).select("target_id", "document_id", "created_at")
    several = keys.where("n_keys > 1").select("target_id")
    shared = mine.join(several, "target_id", "left_semi").join(keyed, "source_key").select("target_id", "document_id")
    cited = targets.join(citations, targets["document_id"] == citations["cited_id"]).select(citations["cited_id"].alias("target_id"), citations["document_id"])
    later = targets.join(links, targets["document_id"] == links["supersedes"]).select(links["supersedes"].alias("target_id"), links["id"].alias("document_id"))
    found = shared.union(cited).union(later).where("target_id != document_id").distinct().join(times, "document_id")
    after = found.join(own, "target_id").where("created_at > t").drop("t")
    # without what the numbers of the key count already
    besides = after.join(one, "target_id", "left").join(keyed.withColumn("_in", F.lit(True)), ["document_id", "source_key"], "left").where("_in IS NULL").select("target_id", "document_id", "created_at")
    order = Window.partitionBy("target_id").orderBy("created_at", "document_id")
    ranked = besides.withColumn("more", F.lit(1)).unionByName(nearest.withColumn("more", F.lit(0))).withColumn("k", F.row_number().over(order)).groupBy("target_id")
    some = ranked.agg(F.sum("more").alias("more"), F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "document_id")))).alias("f"))
    return some.join(counts, "target_id", "left").select("target_id", (F.col("more") + F.coalesce("n_shared", F.lit(0))).alias("n"), F.transform("f", lambda x: x["document_id"]).alias("first"))


def lineage_decisions(decisions: DataFrame, lineage: DataFrame, most: int = 5) -> DataFrame:
    """(root, document_id, depth): newest decisions (session_id, document_id, sequence) along each lineage (root, session_id, depth), nearest session first."""
    order = Window.partitionBy("root").orderBy("depth", F.desc("sequence"), "document_id")
    met = decisions.join(lineage, "session_id").dropDuplicates(["root", "document_id"])
    return met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("root", "document_id", "depth")


def externalized(results: DataFrame, each: int = 4_000, floor: int = 1_000, share: int = 30_000) -> DataFrame:
    """Adds external to tool results (conv_id, turn, tokens): those above the limit, which falls to the floor once inlined ones have used up the share.

    What is inlined so far decides on the next, so the sum is a fold along each conversation's sorted results, inside one expression.
    """
    rows = results.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("tokens").cast("long").alias("tokens")))).alias("r"))

    def step(acc, x):
        out = x["tokens"] > F.when(acc["used"] >= share, F.lit(floor)).otherwise(F.lit(each))
        return F.struct((acc["used"] + F.when(out, F.lit(0)).otherwise(x["tokens"])).alias("used"), F.concat(acc["done"], F.array(F.struct(x["turn"].alias("turn"), x["tokens"].alias("tokens"), out.alias("external")))).alias("done"))

    turn = results.schema["turn"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<turn:{turn},tokens:bigint,external:boolean>>").alias("done"))
    return rows.select("conv_id", F.inline(F.aggregate("r", start, step, lambda acc: acc["done"])))


def rotation(turns: DataFrame, target: int, retain: int = 4, reserve: int = 1_000) -> DataFrame:
    """(conv_id, first_kept, kept, mode): the longest suffix of at most retain turns (conv_id, turn_group, tokens) that fits in target with the reserve.

    normal if it has all the turns asked for, emergency-retention if fewer, compaction (null start) if not even the last turn fits.
    """
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn_group")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("k", F.count(F.lit(1)).over(back)).withColumn("sum", F.sum("tokens").over(back))
    fits = (F.col("k") <= retain) & (F.col("sum") + reserve <= target)
    got = placed.groupBy("conv_id").agg(F.max("k").alias("all"), F.min(F.when(fits, F.col("turn_group"))).alias("first_kept"), F.count_if(fits).alias("kept"))
    mode = F.when(F.col("kept") == 0, "compaction").when(F.col("kept") == F.least(F.col("all"), F.lit(retain)), "normal").otherwise("emergency-retention")
    return got.select("conv_id", "first_kept", "kept", mode.alias("mode"))


def merged_newest(rows: DataFrame, lineage: DataFrame, budget: int) -> DataFrame:
    """(root, rank, session_id, id): the rows (session_id, created_at, id) that a newest-first merge of each lineage's sessions (root, session_id, depth) reads when it may read budget rows.

    Such a merge holds the next row of every session and reads on where it took one. So the nearest sessions' newest rows are read first, as far as the budget goes; what is left of it goes to the rows whose
    predecessor in their own session is newest. That order is what this ranks, without a merge in any task: a session's first budget rows, then a lineage's first budget rows, each cut before a shuffle.
    No session, however large, keeps a nearer or further one from being read. Ties: the larger id is newer; a session that a lineage names twice counts at its least depth.
    """
    line = lineage.groupBy("root", "session_id").agg(F.min("depth").alias("depth"))
    newest = [F.desc("created_at"), F.desc("id")]
    slim = rows.where("session_id IS NOT NULL").select("session_id", "created_at", "id")
    few = slim.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(*newest))).where(F.col("n") <= budget)
    before = F.lag(F.struct("created_at", "id")).over(Window.partitionBy("session_id").orderBy("n"))
    met = few.withColumn("before", before).join(line, "session_id")
    reads = Window.partitionBy("root").orderBy(F.col("n") > 1, F.when(F.col("n") == 1, F.col("depth")), F.when(F.col("n") == 1, F.col("session_id")), F.desc("before"), "session_id")
    read = met.withColumn("k", F.row_number().over(reads)).where(F.col("k") <= budget)
    return read.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*newest, "session_id"))).select("root", "rank", "session_id", "id")
