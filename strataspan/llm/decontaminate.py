"""Benchmark decontamination by winnowing.

A text's fingerprints are the least hashes of its runs of K words in each sliding window of W such runs, K + W - 1 being the length of a benchmark window; so whatever passage of
that length two texts share, both keep the same run of it. Fingerprints of the benchmark are few beside those of the corpus: a bitmap of bounded size lets a task pass over
fingerprints that no item has. A fingerprint that may be there is extended to every window of which it is the least run, and fingerprints and windows are joined with those of
the benchmark: on the fingerprint together with the hash of the window, so that a frequent run of words meets no window but its own, and then by the window's words themselves. An item shorter than a window is
one window, all of whose words are one run.

Distinct windows are joined, not items. The items of the windows are gathered once for each set of windows that documents hold, so a passage of many items or of many documents isn't multiplied out.

Null texts and texts without words have no windows. Repeated documents are reported each. Repeated items count once by item_id; those without an id are one item, of an empty name. Empty tables on either
side give no hits. Extra columns are not read. A text of any length is read whole; a word of any length is one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspan.llm.shared import Scratch, looked_up

#: Words of a benchmark window, and of a run within it.
WINDOW, RUN = 10, 6
#: Bits of the bitmap of fingerprints: 16 a fingerprint, within these bounds (32 MB at most).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Bytes of text that are hashed at once.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(base), dtype=np.uint64)]), dtype=np.uint64)


_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] += 32


class Words:
    """The words of a batch of texts: byte ranges, hashes, and the words of each text from first[i] to first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        starts, ends, hashes = [], [], []
        for lo, hi in self._pieces(offsets):
            s, e, h = self._hashed(lo, hi, offsets)
            starts.append(s)
            ends.append(e)
            hashes.append(h)
        self.starts, self.ends = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.first = np.searchsorted(self.starts, offsets)

    def _pieces(self, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Byte ranges of about PIECE that end where no word goes on: at a text's end or before a byte of no word."""
        lo, end = int(offsets[0]), int(offsets[-1])
        while lo < end:
            hi = min(lo + PIECE, end)
            while hi < end and _IS_WORD[self.data[hi]] and offsets[np.searchsorted(offsets, hi)] != hi:
                stop = int(offsets[np.searchsorted(offsets, hi)])
                part = _IS_WORD[self.data[hi : min(hi + 4096, stop)]]
                hi += len(part) if part.all() else int(part.argmin())
            yield lo, hi
            lo = hi

    def _hashed(self, lo: int, hi: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = self.data[lo:hi]
        inside = _IS_WORD[raw]
        edges = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
        before[edges[edges < len(raw)]] = False
        after[edges[edges > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        up, down = _powers_to(len(raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum((_FOLDED[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
            hashes = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        return starts + lo, ends + lo, hashes

    def runs(self, n: int) -> np.ndarray:
        """Hash of the run of n words that begins at each word; meaningless where it would leave its text."""
        with np.errstate(over="ignore"):
            out, m = np.zeros(len(self.hashes), dtype=np.uint64), len(self.hashes)
            for i in range(min(n, m)):
                out[: m - i] += self.hashes[i:] * np.uint64(pow(_BASE, i + 1, 1 << 64))
            return _mixed(out + np.uint64(n))

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text."""
        counts = np.diff(self.first)
        return np.repeat(self.first[1:], counts) - np.arange(len(self.starts))

    def text(self, at: int, n: int) -> str:
        """The n words at a place, in lower case, joined by one space."""
        raw = [_FOLDED[self.data[self.starts[i] : self.ends[i]]].tobytes() for i in range(at, at + n)]
        return b" ".join(raw).decode("utf-8", "replace")


_known_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _known_powers or len(_known_powers[0][0]) < n:
        _known_powers[:] = [(_powers(_BASE, max(n, PIECE + 1)), _powers(pow(_BASE, -1, 1 << 64), max(n, PIECE + 1)))]
    return _known_powers[0]


def least_runs(words: Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, least, fingerprint): every place at which a window of so many words stands in its text, the place of its least run (the first of equal ones) and that run's hash."""
    span = window - run + 1
    at = np.flatnonzero(words.room() >= window)
    hashes = words.runs(run)
    least, best = at.copy(), hashes[at]
    for i in range(1, span):
        other = hashes[at + i]
        better = other < best
        least[better], best[better] = at[better] + i, other[better]
    return at, least, best


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


def _slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch by rows that hold about so many bytes of text together."""
    sizes = np.diff(_texts(batch.column(text))[1])
    part, at = np.cumsum(sizes) // most, 0
    for cut in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
        if cut > at:
            yield batch.slice(at, cut - at)
        at = cut


_ITEM = "item string, window int, fingerprint long, hash long, words string"


def _item_windows(window: int, run: int):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text", 4 << 20):
                words = Words(*_texts(batch.column("text")))
                counts = np.diff(words.first)
                owner = np.repeat(np.arange(batch.num_rows), counts)
                cols: list[list] = [[], [], [], [], []]
                for n in sorted({min(window, c) for c in counts.tolist() if c}):
                    at, _, fingerprint = least_runs(words, n, run if n == window else n)
                    kept = (counts[owner[at]] >= window) if n == window else (counts[owner[at]] == n)
                    at, fingerprint = at[kept], fingerprint[kept]
                    cols[0] += batch.column("item").take(pa.array(owner[at])).to_pylist()
                    cols[1] += [n] * len(at)
                    cols[2] += fingerprint.view(np.int64).tolist()
                    cols[3] += words.runs(n)[at].view(np.int64).tolist()
                    cols[4] += [words.text(a, n) for a in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["item", "window", "fingerprint", "hash", "words"])

    return run_


def item_windows(items: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(item, window, fingerprint, hash, words): every window of every item of items (item_id, text), window being its number of words."""
    slim = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return slim.mapInArrow(_item_windows(window, run), _ITEM)


class Bitmap:
    """Which fingerprints may be there."""

    def __init__(self, fingerprints: DataFrame):
        n_bits, wanted = LEAST_BITS, 16 * fingerprints.count()
        while n_bits < min(wanted, MOST_BITS):
            n_bits *= 2
        place = F.pmod("fingerprint", F.lit(n_bits)) + 1  # bits are counted from 1
        maps = fingerprints.select(place.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
        self.bits = np.zeros(n_bits // 8 + 4096, dtype=np.uint8)
        for r in maps.toLocalIterator():  # 4 kB a row, 32 MB at most
            at = (r["bucket"] - 1) * 4096
            self.bits[at : at + 4096] = np.frombuffer(bytes(r["map"]), dtype=np.uint8)
        self.n_bits = n_bits

    def has(self, fingerprints: np.ndarray) -> np.ndarray:
        place = (fingerprints & np.uint64(self.n_bits - 1)).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


_FOUND = "uid long, doc_id long, n_words long, at int, window int, fingerprint long, hash long, words string"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())


def _doc_windows(bitmaps, window: int, run: int):
    """Rows of documents (at null), and of those of their windows whose fingerprints may be in the benchmark."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _FOUND.split(", ")]
        for whole in batches:
            for batch in _slices(whole, "text", 4 << 20):
                words = Words(*_texts(batch.column("text")))
                n, counts = batch.num_rows, np.diff(words.first)
                none = [pa.nulls(n, k) for k in _KINDS[3:]]
                yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(counts, pa.int64()), *none], names=names)
                owner = np.repeat(np.arange(n), counts)
                for size, bitmap in bitmaps.value.items():
                    at, _, fingerprint = least_runs(words, size, run if size == window else size)
                    hit = bitmap.has(fingerprint)
                    at, fingerprint = at[hit], fingerprint[hit]
                    hashes = words.runs(size)[at] if len(at) else np.empty(0, np.uint64)
                    for i in range(0, len(at), 20_000):
                        a = at[i : i + 20_000]
                        own = owner[a]
                        cols = [batch.column("uid").take(pa.array(own)), pa.nulls(len(a), _KINDS[1]), pa.nulls(len(a), _KINDS[2]), pa.array(a - words.first[own], pa.int32()), pa.array(np.full(len(a), size), pa.int32()),
                                pa.array(fingerprint[i : i + 20_000].view(np.int64)), pa.array(hashes[i : i + 20_000].view(np.int64)), pa.array([words.text(x, size) for x in a.tolist()], pa.string())]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    return run_


def _merged(hits: DataFrame) -> DataFrame:
    """(uid, spans) of hits (uid, at, window): spans (start, end) in order, those that touch or overlap joined. Linear in a document's hits."""
    ends = hits.groupBy("uid", "at").agg((F.col("at") + F.max("window")).alias("end"))
    along = Window.partitionBy("uid").orderBy("at")
    opens = ends.withColumn("new", F.when(F.col("at") <= F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    parts = opens.withColumn("part", F.sum("new").over(along)).groupBy("uid", "part").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    return parts.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, spans, item_ids) of every row of docs (doc_id, text): spans, an array of (start, end), are the places of the words that stand in windows of items (item_id, text), joined
    where they touch; item_ids, an array of sorted strings, are the items whose windows occur."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    each = scratch.put(item_windows(items, window, run), "items")
    # one row for each distinct window; windows of the same items are of one set
    sets = each.groupBy("window", "fingerprint", "hash", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    distinct = scratch.put(sets.withColumn("set_id", F.xxhash64(F.sha2(F.array_join("items", ","), 256))), "windows")
    sizes = [r[0] for r in distinct.select("window").distinct().collect()]  # 1 to window
    bitmaps = spark.sparkContext.broadcast({n: Bitmap(distinct.where(F.col("window") == n).select("fingerprint").distinct()) for n in sorted(sizes)})
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "text")
    found = scratch.put(rows.mapInArrow(_doc_windows(bitmaps, window, run), _FOUND), "found")
    maybe = found.where("at IS NOT NULL").select("uid", "at", "window", F.struct("fingerprint", "hash", "window", "words").alias("key"))
    n_maybe = maybe.count()
    per = maybe.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    real = distinct.select(F.struct("fingerprint", "hash", "window", "words").alias("key"), "set_id").join(per, "key")
    hits = scratch.put(looked_up(maybe, scratch.put(real, "real"), "key", "n_rows", n_maybe).select("uid", "at", "window", "set_id"), "hits")
    sets_of = hits.groupBy("uid").agg(F.array_sort(F.collect_set("set_id")).alias("sets"))
    held = scratch.put(_merged(hits).join(sets_of, "uid").withColumn("class", F.xxhash64("sets")), "held")
    # the items of each combination of sets, once
    classes = held.select("class", "sets").distinct().select("class", "sets", F.explode("sets").alias("set_id"))
    named = classes.join(distinct.select("set_id", "items").dropDuplicates(["set_id"]), "set_id")
    union = named.select("class", "sets", F.explode("items").alias("item")).groupBy("class", "sets").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    met = held.join(union, ["class", "sets"]).select("uid", "spans", "item_ids")
    plain = found.where("n_words IS NOT NULL").select("uid", "doc_id", "n_words")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return plain.join(met, "uid", "left").select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return contamination(docs, items).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SQL_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS s
      FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM v),
e AS (SELECT uid, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, k)),
h AS (SELECT DISTINCT uid, p, n FROM e SEMI JOIN v USING (n, s)),
c AS (SELECT uid, count(DISTINCT x) AS n_hit FROM (SELECT uid, unnest(range(p, p + n)) AS x FROM h) GROUP BY uid),
t AS (SELECT DISTINCT uid, item FROM e JOIN v USING (n, s)),
g AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM t GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (uid) LEFT JOIN g USING (uid)
"""
