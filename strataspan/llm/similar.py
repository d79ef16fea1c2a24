"""Exact comparison of hashed gram sets in numpy: pairs in batches, and whole groups in blocks of bounded size.

A group of m members is dealt into blocks; every pair of blocks, and every block with itself, is a cell, and a cell is one unit of work of bounded
memory. Within a cell the grams that each two sets share are counted for all pairs at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block, about. An element is frequent in a cell if more than 1 of OFTEN of its sets have it; so many frequent ones are counted at once.
BLOCK, OFTEN, COLUMNS = 384, 16, 2048

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def is_similar(both, na, nb, threshold: float):
    """Jaccard similarity of at least the threshold, from the sizes; nothing is similar to a set with which it shares nothing."""
    return (both > 0) & (both >= threshold * (na + nb - both) - 1e-9)


def shared_counts(sets: list[np.ndarray], left: int | None = None) -> np.ndarray:
    """both[i, j] for i < j: how many elements sets i and j share. left: counted between the first left sets and the others at least.

    Elements of many sets are columns of 0 and 1, taken some at a time, whose products are summed; of the others each pair of owners is counted.
    """
    n, df, inverse = len(sets), np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    if len(owner):
        _, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners, first = owner[np.argsort(inverse, kind="stable")], np.cumsum(df) - df  # ascending for each element
    often = df > max(2, n // OFTEN)
    both, mid = np.zeros((n, n), dtype=np.float32), left or 0
    rows, at = owners[np.repeat(often, df)], np.concatenate(([0], np.cumsum(df[often])))
    for c in range(0, len(at) - 1, COLUMNS):
        own = at[c : c + COLUMNS + 1]
        x = np.zeros((n, len(own) - 1), dtype=np.float32)
        x[rows[own[0] : own[-1]], np.repeat(np.arange(len(own) - 1), np.diff(own))] = 1
        both[: mid or n, mid:] += x[: mid or n] @ x[mid:].T
    for d in np.unique(df[~often & (df > 1)]).tolist():
        x, y = np.triu_indices(d, 1)
        starts, step = first[~often & (df == d)], max(1, (1 << 20) // len(x))
        for k in range(0, len(starts), step):
            own = owners[starts[k : k + step, None] + np.arange(d)]
            both += np.bincount((own[:, x] * n + own[:, y]).ravel(), minlength=n * n).reshape(n, n).astype(np.float32)
    return both


def similar_in_cell(sets: list[np.ndarray], threshold: float, left: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, indexes of the sets similar to set i): every similar pair once. left: pairs between the first left sets and the others only."""
    if not sets or left == 0:
        return
    sizes, both = np.array([len(s) for s in sets], dtype=np.int64), shared_counts(sets, left)
    for i in range(len(sets) if left is None else left):
        beside = max(i + 1, left or 0)
        found = beside + np.flatnonzero(is_similar(both[i, beside:].astype(np.int64), sizes[i], sizes[beside:], threshold))
        if len(found):
            yield i, found


def in_cells(members: DataFrame, texts: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Members (group, key, m, ...), m being the size of the group, dealt to the cells (group, ci, cj) of their group, with their texts (key, text).

    Rows of a cell lie together and in order, as cell_links needs. A member goes to as many cells as its group has blocks.
    """
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("ci", F.least("block", "other")).withColumn("cj", F.greatest("block", "other")).join(texts, key)
    return cells.repartition("group", "ci", "cj").sortWithinPartitions("group", "ci", "cj", "block")


def cell_links(grams: Callable, threshold: float, count: bool, likely: Callable | None = None):
    """For mapInArrow over in_cells() as (group, ci, cj, block, key, comp, text), comp being null with count. Yields (key, links): how many texts of the
    cell are similar to a text, or (a, b): links that join all similar texts of different components. grams makes a function from text to set, which may have one for many texts. likely,
    if any, says from a further column sketch, components and the first block's size which rows of a cell need to be compared."""

    def judged(cell: list[tuple], of_text: Callable) -> Iterator[tuple]:
        i, j = cell[0][1:3]
        left = sum(1 for r in cell if r[3] == i)
        if i != j and left in (0, len(cell)):
            return
        if likely is not None:
            comps = {c: k for k, c in enumerate(dict.fromkeys(r[5] for r in cell))}
            keep = likely([r[7] for r in cell], np.array([comps[r[5]] for r in cell]), left if i != j else None)
            cell = [r for r, fine in zip(cell, keep, strict=True) if fine]
            left = sum(1 for r in cell if r[3] == i)
            if len(cell) < 2:
                return
        keys = [r[4] for r in cell]
        texts = [r[6] for r in cell]
        sets = of_text.many(texts) if hasattr(of_text, "many") else list(map(of_text, texts))
        pairs = similar_in_cell(sets, threshold, left if i != j else None)
        if count:
            links = np.zeros(len(cell), dtype=np.int64)
            for k, near in pairs:
                links[k] += len(near)
                links[near] += 1
            yield from ((keys[k], int(links[k])) for k in np.flatnonzero(links))
            return
        known = {c: k for k, c in enumerate(dict.fromkeys(r[5] for r in cell))}
        root = np.array([known[r[5]] for r in cell])
        for k, near in pairs:
            while len(near := near[root[near] != root[k]]):
                yield keys[k], keys[near[0]]
                root[root == root[near[0]]] = root[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text = grams()
        cell: list[tuple] = []
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            names, kinds = (("key", "links"), (key_type, pa.int64())) if count else (("a", "b"), (key_type, key_type))
            cols = list(zip(*out, strict=True)) if out else [[], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))

        key_type = pa.binary()
        for batch in batches:
            key_type = batch.schema.field(4).type
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if cell and row[:3] != cell[0][:3]:
                    out += judged(cell, of_text)
                    cell = []
                cell.append(row)
            if len(out) > 10_000:
                yield flushed()
        if cell:
            out += judged(cell, of_text)
        if out:
            yield flushed()

    return run
