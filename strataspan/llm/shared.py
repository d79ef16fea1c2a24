"""Scratch tables in the cluster's shared folder, distributed connected components, joins that survive hot keys, names that don't clash, and the
word rule that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary folder of our own only where that is unset and all runs in one process (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="strataspan-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


class Scratch:
    """Tables of one run of an operator. put() writes one and cuts its lineage; drop() frees one that no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, name: str = "t", options: dict[str, str] | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.options(**(options or {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            if t is not None and (at := getattr(t, "_scratch_path", None)):
                path = jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text) -> F.Column:
    """Words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of the undirected edges (a, b): one row (node, comp) for each node of an edge, comp being one node of its component.

    Each round maps every node to its least neighbour or itself and contracts the edges by that map. Nodes should be hashes, so that
    their order is random; a round then removes a constant share of the edges whatever the graph's diameter. Nothing is collected:
    the loop looks only at whether edges are left.
    """
    left = scratch.put(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    comp = None
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("low")), "low")
        if comp is None:
            new = low.select("node", F.col("low").alias("comp"))
        else:
            step = low.select(F.col("node").alias("comp"), "low")
            new = scratch.put(comp.join(step, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp")), "comp")
        la, lb = low.select(F.col("node").alias("a"), F.col("low").alias("la")), low.select(F.col("node").alias("b"), F.col("low").alias("lb"))
        moved = left.join(la, "a").join(lb, "b").where("la != lb")
        nxt = scratch.put(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if comp is not None:
            scratch.drop(comp, low)
        scratch.drop(left)
        comp, left = new, nxt
        if not hasattr(comp, "_scratch_path"):
            comp._scratch_path = low._scratch_path
    if comp is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return comp


def more_components(known: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (node, comp) of the edges of known components and further ones, at the cost of the further ones."""

    def named(side: str) -> DataFrame:
        return known.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))

    between = edges.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = connected_components(between, scratch).select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
    old = known.join(up, "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp"))
    new = up.select(F.col("comp").alias("node"), F.col("_up").alias("comp")).join(known.select("node"), "node", "left_anti")
    return scratch.put(old.unionByName(new), "comp")


def free_name(base: str, *frames: DataFrame) -> str:
    """base, or base with underscores behind it, so that it is no column of these frames in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most this many rows of df whose key isn't null, chosen by a hash of the key, the same ones in every run.

    A threshold on the hash, from the number of rows, leaves about 1.5 times as many before they are put in order in one task.
    """
    some = df.where(F.col(key).isNotNull())
    span = 1 << 31
    share = min(1.0, (1.5 * most + 100) / max(1, some.count()))
    mark = F.xxhash64(F.lit("sample"), F.col(key).cast("string"))
    return some.where(F.pmod(mark, F.lit(span)) < int(share * span)).orderBy(mark, key).limit(most)


#: A key of more than this share of a table's rows is hot, so there are fewer than HOT_KEYS hot keys: their rows may be broadcast.
HOT_KEYS, HOT_ROWS = 10_000, 1_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str, n_rows: int) -> DataFrame:
    """Inner join of rows with a table that has one row for each key; its column count (dropped) says how many of the n_rows rows have that key.

    The table's rows of hot keys are broadcast: their counts exceed n_rows / HOT_KEYS, so they are fewer than HOT_KEYS. All others are joined
    by a shuffle, in which no key has more than that many rows.
    """
    least = max(HOT_ROWS, n_rows // HOT_KEYS)
    hot = F.broadcast(table.where(F.col(count) > least).drop(count))
    cold = table.where(F.col(count) <= least).drop(count)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


#: Bits of a key filter: 16 a key, within these bounds. A row of the broadcast table holds 32768 bits, so it has 32 MB at most.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def maybe_in(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column may be among keys (one column of that name): all that are, and few others while keys are below MOST_BITS / 16.

    A filter before a join, in DataFrame operations: keys set bits of a bitmap of bounded size.
    """
    n_bits, wanted = LEAST_BITS, 16 * keys.count()
    while n_bits < min(wanted, MOST_BITS):
        n_bits *= 2

    def bit(c: str) -> F.Column:
        return F.pmod(F.xxhash64(c), F.lit(n_bits))

    names = {c: free_name(f"_{c}", df) for c in ("bit", "bucket", "at", "map")}
    bits = keys.select(bit(column).alias("_bit"))
    maps = bits.groupBy(F.bitmap_bucket_number("_bit").alias(names["bucket"])).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias(names["map"]))
    at = df.withColumn(names["bit"], bit(column)).withColumns({names["bucket"]: F.bitmap_bucket_number(names["bit"]), names["at"]: F.bitmap_bit_position(names["bit"])})
    met = at.join(F.broadcast(maps), names["bucket"])
    byte = F.conv(F.hex(F.substr(names["map"], (F.floor(F.col(names["at"]) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.get(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col(names["at"]) % 8).cast("int")).bitwiseAND(byte) != 0
    return met.where(hit).select(*df.columns)
