"""N-gram Jaccard join by a MinHash LSH forest.

Texts are sets of word 5-grams. Each of several trees labels a text with a sequence of minima; all labels of a tree in sorted order are a prefix trie, whose
nodes are runs of labels with a common prefix. The sorted labels are dealt out by range and walked once: every text is paired with the first text of the deepest
node that it shares, the longest matched prefix first. Then prefixes are shortened, for each text only as far as its target recall needs: a
text of few grams has few possible similarities, and the least of them at or above the threshold says at which prefix length a similar text shares a node in
some tree with the target probability. Nodes of that length that still hold several classes are compared whole, in cells of bounded size with prefix and length
filters. Every link is verified on the exact 5-gram sets. Links of a text are then counted within its class, again in cells, so that no list of all pairs of a
large class is ever made.

Equal texts are one text throughout: a row's links are the number of different texts that are similar to its own. Texts of fewer than five
words are one gram of all their words; texts without words (empty, null) have no grams and no links, and only equal ones share a class. Repeated
rows get equal results; class ids are the least doc_id of the class (null only if all are null). An empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm import similar
from strataspan.llm.shared import Scratch, connected_components, free_name, looked_up, more_components
from strataspan.llm.similar import mixed

GRAM, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.99
TREES, LABEL = 16, 8

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as far as needed."""

    def __init__(self):
        self.n, self.up, self.down = 0, None, None

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(self.n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))


def grams(text: bytes, powers: Powers, n: int = GRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a UTF-8 text."""
    raw = np.frombuffer(text, dtype=np.uint8)
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    powers.upto(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers.up[: len(raw)])))
        words = mixed((total[end] - total[start]) * powers.down[start] + (end - start).astype(np.uint64))
        k = min(n, len(words))
        out = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            out = mixed(out) + words[i : len(words) - k + 1 + i]
        if k < n:
            out = out + np.uint64(k)
        return np.unique(mixed(out))


@lru_cache(maxsize=100_000)
def least_similarity(n: int, threshold: float) -> float:
    """The least similarity of at least the threshold that a set of n grams can have with another set: n is small, else it is about the threshold."""
    if n > 64:
        return threshold
    return min(c / (n + m - c) for m in range(1, 2 * n + 1) for c in range(1, min(n, m) + 1) if c >= threshold * (n + m - c) - 1e-9)


@lru_cache(maxsize=100_000)
def depth_needed(n: int, trees: int, label: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a text of n grams shares a node of some tree with a similar text with the target probability."""
    s, d = least_similarity(n, threshold), label
    while d > 1 and 1 - (1 - s**d) ** trees < recall:
        d -= 1
    return d


def _signer(trees: int, label: int, threshold: float, recall: float):
    """For mapInArrow over (doc_id, text as binary): doc_id, tid, grams, need (prefix length) and labels, one for each tree, that sort as their minima do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20)
        flip = rng.integers(0, 1 << 32, trees * label, dtype=np.uint64).astype(np.uint32)
        factor = (rng.integers(0, 1 << 32, trees * label, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        powers = Powers()
        for batch in batches:
            keys, sizes, needs, labels = [], [], [], []
            with np.errstate(over="ignore"):
                for text in batch.column(1).to_pylist():
                    g = grams(text or b"", powers)
                    keys.append(hashlib.sha256(text or b"").digest()[:16])
                    sizes.append(len(g))
                    if not len(g):
                        needs.append(None)
                        labels.append(None)
                        continue
                    needs.append(depth_needed(min(len(g), 65), trees, label, threshold, recall))
                    g32 = (g >> np.uint64(32)).astype(np.uint32)
                    low = np.full(trees * label, np.uint32(2**32 - 1))
                    for i in range(0, len(g32), 1024):
                        low = np.minimum(low, ((g32[i : i + 1024, None] ^ flip) * factor).min(axis=0))
                    raw = low.astype(">u4").tobytes()
                    labels.append([raw[i : i + 4 * label] for i in range(0, len(raw), 4 * label)])
            cols = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), pa.array(labels, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tid", "grams", "need", "labels"])

    return run


def _walker(label: int, least: int, small: int):
    """For mapInArrow over sorted (tree, label, tid, need, grams), a range of the tries in each task. Yields (kind, node, a, b):

    0: texts a and b, b being the first text of the deepest node that both share; 1: text a is in this node, which is of the prefix length that a text in it
    needs and has several texts, or may have them beyond the range's ends; 2: text a is the first text of a node that may go on beyond the range's ends.
    least is the shortest prefix that any text needs; texts of more than small grams aren't similar to any text that needs a longer one.
    """
    kinds = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def named(row: np.ndarray, d: int) -> int:
        return int.from_bytes(hashlib.blake2b(row[: d + 1].tobytes(), digest_size=8, key=bytes([d])).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_nodes, begun, out = None, {}, set(), []

        def cut(d: int) -> None:
            """A node that began with the range or is cut by its end: its first text, which is a member too."""
            tid, node, _ = open_nodes[d]
            out.extend([(2, node, tid, None), (1, node, tid, None)])

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = np.column_stack([batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint32), np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u4").astype(np.uint32).reshape(n, label)])
            before = np.vstack([rows[:1] if last is None else last, rows[:-1]])
            first = last is None
            lcp = np.maximum(np.cumprod(rows == before, axis=1).sum(axis=1) - 1, 0)
            if first:
                lcp[0] = 0
            last = rows[-1:]
            shared = (lcp >= least) | np.append(lcp[1:] >= least, True)
            shared[0] = True
            tids, needs, sizes = batch.column(2), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(shared):
                tid = tids[i].as_py()
                for d in [d for d in open_nodes if d > lcp[i]]:
                    if d in begun:
                        cut(d)
                        begun.discard(d)
                    del open_nodes[d]
                met = False
                for d in range(label, max(least, int(needs[i])) - 1, -1):
                    if d not in open_nodes:
                        open_nodes[d] = [tid, named(rows[i], d), False]
                        continue
                    own = open_nodes[d]
                    if not met:
                        out.append((0, None, tid, own[0]))
                        met = True
                    if d == least or sizes[i] <= small:
                        if not own[2]:
                            out.append((1, own[1], own[0], None))
                            own[2] = True
                        out.append((1, own[1], tid, None))
                if first:
                    begun, first = set(open_nodes), False
            if len(out) > 10_000:
                yield flushed()
        for d in open_nodes:
            cut(d)
        if out:
            yield flushed()

    return run


def _verified(threshold: float):
    """For mapInArrow over (a, b, text_a, text_b): the pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, last, last_set = Powers(), None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2), batch.column(3)
            good = []
            for i in range(len(a)):
                if a[i] != last:
                    last, last_set = a[i], grams(ta[i].as_py(), powers)
                own = grams(tb[i].as_py(), powers)
                if similar.is_similar(len(np.intersect1d(last_set, own, assume_unique=True)), len(last_set), len(own), threshold):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.binary()), pa.array([b[i] for i in good], pa.binary())], names=["a", "b"])

    return run


def word_grams():
    """A function from a text as bytes to its set of grams."""
    powers = Powers()
    return lambda text: grams(text, powers)


def candidates(signed: DataFrame, scratch: Scratch, trees: int, label: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of tids, each text with the first one of its deepest shared node; and members (node, tid) of the nodes of the lengths needed."""
    needs = [depth_needed(n, trees, label, threshold, recall) for n in range(1, 66)]
    least = min(needs)
    small = max([ceil(n / threshold) for n, d in enumerate(needs, 1) if d > least], default=0)
    one = signed.where("grams > 0").groupBy("tid").agg(*[F.first(c).alias(c) for c in ("need", "grams", "labels")])
    tries = scratch.put(one.select("tid", "need", "grams", F.posexplode("labels").alias("tree", "label")), "labels")
    ordered = tries.select("tree", "label", "tid", "need", "grams").repartitionByRange("tree", "label", "tid").sortWithinPartitions("tree", "label", "tid")
    walked = scratch.put(ordered.mapInArrow(_walker(label, least, small), "kind int, node long, a binary, b binary"), "walked")
    scratch.drop(tries)
    # nodes that lie in several ranges: their first texts are paired with the least of them
    cut = walked.where("kind = 2").groupBy("node").agg(F.collect_set("a").alias("own"))  # at most one a range
    cut = cut.where(F.size("own") > 1).withColumn("b", F.array_min("own")).select(F.explode("own").alias("a"), "b").where("a != b")
    pairs = walked.where("kind = 0").select("a", "b").unionByName(cut)
    members = walked.where("kind = 1").select("node", F.col("a").alias("tid")).distinct()
    return scratch.put(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs"), members


def near_classes(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, trees: int = TREES, label: int = LABEL, block: int = similar.BLOCK, links: bool = True
) -> DataFrame:
    """doc_id, tid (a digest of the text), comp (null if no other text is similar), links and class_id of each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "ngram_jaccard")
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    signed = scratch.put(slim.mapInArrow(_signer(trees, label, threshold, recall), "doc_id long, tid binary, grams int, need int, labels array<binary>"), "signed")
    pairs, members = candidates(signed, scratch, trees, label, threshold, recall)
    # Texts that meet another one somewhere: only these are moved.
    ids = pairs.select(F.col("a").alias("tid")).unionByName(pairs.select(F.col("b").alias("tid"))).unionByName(members.select("tid")).distinct()
    own_tid = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    texts = scratch.put(slim.select(own_tid.alias("tid"), "text").join(ids, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text")), "texts")
    joined = pairs.join(texts.withColumnRenamed("tid", "b").withColumnRenamed("text", "text_b"), "b").join(texts.withColumnRenamed("tid", "a").withColumnRenamed("text", "text_a"), "a")
    comp = connected_components(scratch.put(joined.select("a", "b", "text_a", "text_b").mapInArrow(_verified(threshold), "a binary, b binary"), "links"), scratch)
    # Whole comparison of the nodes that still hold several classes; nodes with the same texts are compared once.
    classed = members.join(comp.withColumnRenamed("node", "tid"), "tid", "left").withColumn("comp", F.coalesce("comp", "tid"))
    several = classed.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("tid").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("m"))
    several = scratch.put(several.where("lo != hi").groupBy("h", "m").agg(F.min("node").alias("node")).select("node", "m"), "several")
    if not several.isEmpty():
        cells = similar.in_cells(classed.join(several, "node").withColumnRenamed("node", "group"), texts, "tid", block).select("group", "ci", "cj", "block", "tid", "comp", "text")
        comp = more_components(comp, scratch.put(cells.mapInArrow(similar.cell_links(word_grams, threshold, False), "a binary, b binary"), "links"), scratch)
    # Of each text the rows and the least doc_id, then of each class; a text or class may hold a large share of all rows.
    rows = signed.select("doc_id", "tid")
    named = rows.groupBy("tid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).join(comp.withColumnRenamed("node", "tid"), "tid", "left")
    named = scratch.put(named.withColumn("class", F.coalesce("comp", "tid")), "named")
    n_texts, n_rows = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = scratch.put(named.groupBy("class").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("m")), "classes")
    out = looked_up(named, least, "class", "m", n_texts).select("tid", "comp", "class_id", "n")
    if links:
        sized = looked_up(named.where("comp IS NOT NULL").select("tid", "class"), least.where("m > 1").select("class", F.col("m").alias("of"), "m"), "class", "of", n_texts)
        cells = similar.in_cells(sized.withColumnRenamed("class", "group"), texts, "tid", block).select("group", "ci", "cj", "block", "tid", F.lit(None).cast("binary").alias("comp"), "text")
        counts = cells.mapInArrow(similar.cell_links(word_grams, threshold, True), "tid binary, links long").groupBy("tid").agg(F.sum("links").alias("links"))
        out = out.join(counts, "tid", "left").withColumn("links", F.coalesce("links", F.lit(0)).cast("long"))
    out = looked_up(rows, scratch.put(out, "texts_out"), "tid", "n", n_rows)
    return out.select("doc_id", "tid", "comp", *(["links"] if links else []), "class_id")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_classes(docs).select("doc_id", "class_id", F.col("links").alias("n_links"))


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the first of their class: least doc_id, then least text digest; of repeated rows one stays. Columns are those of docs."""
    scratch = Scratch(docs.sparkSession, "near_kept")
    classes = near_classes(docs.select("doc_id", "text"), links=False, **options)
    first = classes.groupBy("class_id", F.coalesce("comp", "tid").alias("class")).agg(F.min(F.struct("doc_id", "tid")).alias("k"))
    tid, key, doc_id = (free_name(c, docs) for c in ("_tid", "_key", "_id"))
    keep = scratch.put(first.select(F.col("k.doc_id").alias(doc_id), F.col("k.tid").alias(key)), "keep")
    own = docs.withColumn(tid, F.unhex(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), 1, 32)))
    kept = own.join(keep, (F.col(tid) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)), "left_semi")
    # rows that repeat both doc_id and text
    return kept.dropDuplicates([tid]).select(*[F.col(f"`{c}`") for c in docs.columns])
