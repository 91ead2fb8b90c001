"""Row-wise Arrow steps: new columns beside the old ones, in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 4 << 20
OUT_ROWS = 2048


def with_arrow_columns(
    df: DataFrame,
    fn: Callable[[pa.Table], Sequence],
    schema: str,
    *,
    size_of: str | None = None,
    keep: Sequence[str] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``df`` (only the columns ``keep``, if given) and the columns of ``schema`` from ``fn``.

    ``fn`` sees whole rows as an Arrow table and returns one sequence per new column. Rows come in
    chunks of about ``chunk_bytes`` of the column ``size_of`` (a longer row is a chunk of its own),
    so memory does not follow the partition. Existing columns named like new ones are replaced;
    names are compared as Spark compares them, without regard to case.
    """
    added = T.StructType.fromDDL(schema)
    taken = {f.name.lower() for f in added.fields}
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in taken]
    out = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in kept], *added.fields])
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, size_of, chunk_bytes):
            columns = [table.column(c) for c in kept]
            columns += [_array(v) for v in fn(table)]
            yield from pa.table(columns, names=names).to_batches(max_chunksize=OUT_ROWS)
        # Workers live on: what this task no longer needs goes back before the next one runs.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, out)


def _array(values: Sequence) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def chunks(
    batches: Iterator[pa.RecordBatch], size_of: str | None, chunk_bytes: int
) -> Iterator[pa.Table]:
    """Regroup record batches into tables of about ``chunk_bytes`` of the column ``size_of``."""
    waiting, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size_of is None:
            yield pa.Table.from_batches([batch])
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(size_of)), 0).to_pylist()
        start = 0
        for i, size in enumerate(sizes):
            if held and held + size > chunk_bytes:
                waiting.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(waiting)
                waiting, held, start = [], 0, i
            held += size
        waiting.append(batch.slice(start))
    if any(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting)


def read(spark, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def utf8_bytes(text: str = "text"):
    """Size of a text in UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
