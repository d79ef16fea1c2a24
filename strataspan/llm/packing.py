"""Best-fit packing into bins of several permitted sequence lengths.

Every task packs its own rows in bounded batches. A batch's pieces go in decreasing length to the open bin with the least room that still holds them; if none
does, a bin of the length with the least cost for each token that it can still get is opened: of the pieces left, only those that would fit beside this one
count. A batch is packed under every choice of lengths that may be opened, and the plan of the least total cost stays, so the lengths are optimised jointly.
At the end every bin is downsized to the least permitted length that holds its contents. The cost of a bin is an overhead, its length, and a
part that grows with the square of its length, as attention does. No row is moved between tasks, so a frequent id, source or text weighs on no task more
than its rows do.

Lengths are token counts. A document longer than the largest length is cut into pieces of that length and one remainder. Documents of length 0 (null or empty
texts) take no room: they keep a row, with a null bin. Ties go by the order of the input. Repeated rows are packed one by one. An empty table gives an empty one.
Extra columns are not read. Batches follow the partitions of the input: a rerun over the same files gives the same bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import combinations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.token_counts import counting

SIZES = (512, 1024, 2048, 4096)
#: Cost of a bin besides its length: an overhead, and length * length / SPAN. Pieces in a batch.
OVERHEAD, SPAN, BATCH = 64, 16_384, 50_000


def cost(size: int) -> float:
    return OVERHEAD + size + size * size / SPAN


def _packed_under(lengths: Sequence[int], order: list[int], sizes: Sequence[int], may_open: Sequence[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each length and the fillings of the bins; may_open holds the largest size."""
    place: list[tuple[int, int]] = [(-1, 0)] * len(lengths)
    room: list[tuple[int, int]] = []  # of open bins, sorted
    filled: list[int] = []
    ascending = [lengths[i] for i in reversed(order)]
    total = [0]
    for n in ascending:
        total.append(total[-1] + n)
    for done, i in enumerate(order):
        need = lengths[i]
        k = bisect_left(room, (need, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            left = len(order) - done - 1  # pieces left, the shortest ones of all

            def each_token(s: int) -> tuple[float, int]:
                beside = bisect_left(ascending, s - need + 1, 0, left)
                return cost(s) / min(s, need + total[beside]), s

            free, b = min((s for s in may_open if s >= need), key=each_token), len(filled)
            filled.append(0)
        place[i] = (b, filled[b])
        filled[b] += need
        if free > need:
            insort(room, (free - need, b))
    return place, filled


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each length, none above the largest size, and the sizes of the bins: the cheapest plan over all choices of sizes to open."""
    sizes = sorted(sizes)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    best = None
    for n in range(len(sizes)):
        for some in combinations(sizes[:-1], n):
            place, filled = _packed_under(lengths, order, sizes, [*some, sizes[-1]])
            bins = [sizes[bisect_left(sizes, f)] for f in filled]
            of = sum(map(cost, bins))
            if best is None or of < best[0]:
                best = of, place, bins
    return best[1], best[2]


def _packed(sizes: Sequence[int], batch: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("bin_id", pa.int64()), ("bin_size", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, most = TaskContext.get().partitionId() << 40, max(sizes)
        ids, pieces, lengths = [], [], []

        def flushed() -> pa.RecordBatch:
            nonlocal first
            at = [i for i, n in enumerate(lengths) if n]
            place, bins = best_fit([lengths[i] for i in at], sizes)
            own = dict(zip(at, place, strict=True))
            cols = [ids, pieces, [first + own[i][0] if i in own else None for i in range(len(ids))], [bins[own[i][0]] if i in own else None for i in range(len(ids))],
                    [own[i][1] if i in own else None for i in range(len(ids))], lengths]
            first += len(bins)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for b in batches:
            for doc_id, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for piece in range(max(1, -(-size // most))):
                    ids.append(doc_id)
                    pieces.append(piece)
                    lengths.append(min(most, size - piece * most))
                    if len(ids) >= batch:
                        yield flushed()
                        ids, pieces, lengths = [], [], []
        if ids:
            yield flushed()

    return run


_PLACES = "doc_id long, piece int, bin_id long, bin_size int, start int, length int"


def pack(measured: DataFrame, sizes: Sequence[int] = SIZES, batch: int = BATCH) -> DataFrame:
    """doc_id, piece, bin_id, bin_size, start, length (tokens): a row for each piece of the documents (doc_id, n_tokens)."""
    slim = measured.select(F.col("doc_id").cast("long"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long"))
    return slim.mapInArrow(_packed(tuple(sizes), batch), _PLACES)


def pack_texts(docs: DataFrame, tokenizer_path: str, sizes: Sequence[int] = SIZES, batch: int = BATCH) -> DataFrame:
    """pack() of the token counts of docs (doc_id, text). Texts are counted and packed in one Python worker a task: two nodes would hold two at once."""
    counted, packed = counting(tokenizer_path), _packed(tuple(sizes), batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(b.select(["doc_id", "n_tokens"]) for b in counted(batches))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PLACES)


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(tokenizer))
