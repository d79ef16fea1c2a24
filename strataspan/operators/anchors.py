"""Typed exact anchors of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from strataspan.functions import text as tx
from strataspan.operators.segments import versioned


def extracted(docs: DataFrame, most: int = 50_000, most_bytes: int = 512) -> DataFrame:
    """(document_id, version, type, value, normalized, folded, specificity, start_byte, end_byte) of every document, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, v, t in zip(b["document_id"], b["version"], b["text"], strict=True):
                t, at, done = t or "", 0, 0
                for kind, value, w, a, e in tx.anchors(t)[:most]:
                    if len(value.encode()) <= most_bytes:
                        done += len(t[at:a].encode())  # starts never decrease
                        at = a
                        rows.append((d, v, kind, value, tx.normal_value(value), tx.normal_value(value, True), w, done, done + len(t[a:e].encode())))
            yield pd.DataFrame(rows, columns=["document_id", "version", "type", "value", "normalized", "folded", "specificity", "start_byte", "end_byte"])

    return versioned(docs).mapInPandas(run, "document_id long, version int, type string, value string, normalized string, folded string, specificity double, start_byte long, end_byte long")
