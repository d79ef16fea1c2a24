"""Python over Arrow batches, a few rows at a time: a task holds no more Python objects than a slice needs, whatever a batch holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a slice.
SLICE = 256


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = SLICE) -> DataFrame:
    """df.mapInPandas(run, schema), with frames of at most rows rows."""
    types = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (b.slice(at, rows).to_pandas() for b in batches for at in range(0, b.num_rows, rows))
        for out in run(frames):
            yield pa.RecordBatch.from_pandas(out, schema=types, preserve_index=False)

    return df.mapInArrow(each, schema)
