"""Batches of rows through Python: the shared frame of the operators that need it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows handed to a function at once; long texts make a batch large, so it is cut again here.
CHUNK_ROWS = 512

Rows = Callable[[dict[str, list]], dict[str, list]]


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def map_rows(df: DataFrame, inputs: Sequence[str], make: Callable[[], Rows], schema: StructType) -> DataFrame:
    """Apply a function to chunks of the columns ``inputs``.

    ``make`` runs once per task and returns the function; that one takes a
    dictionary of lists and returns a dictionary of lists, one for each field of
    ``schema``. Only ``inputs`` reach Python, so the scan reads nothing else.
    """
    names = list(inputs)
    out = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(start, CHUNK_ROWS)
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.select(*[df[f"`{n}`"] for n in names]).mapInArrow(run, schema)
