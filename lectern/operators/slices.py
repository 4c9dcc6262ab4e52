"""Python over whole texts, some rows of an Arrow batch at a time, so that a worker holds one batch and what becomes of some rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that are worked on at once.
ROWS = 256


def in_slices(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas of run, which gets ROWS rows at a time."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (whole.slice(at, ROWS).to_pandas() for whole in batches for at in range(0, whole.num_rows, ROWS))
        for made in run(parts):
            yield pa.RecordBatch.from_pandas(made, schema=kinds, preserve_index=False)

    return rows.mapInArrow(of, schema)


def of_strings(f: Callable[[str | None], str | None], text: Column) -> Column:
    """f of each string, null among them."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        made = [pa.array([f(t) for t in texts.slice(at, ROWS).to_pylist()], pa.string()) for at in range(0, len(texts), ROWS)]
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    return of(text)
