"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..runtime import cut, discard, ship

__all__ = ["cut", "discard", "map_columns", "ship", "slices", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, through Spark's reader (any file system Spark knows)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_columns(
    df: DataFrame, schema: str, make: Callable[..., Callable[[dict[str, list]], dict[str, list]]], *args
) -> DataFrame:
    """Apply ``make(*args)`` (built once per task) to each Arrow batch, as column lists.

    The function gets a dict of Python lists and returns a dict of lists or arrays in the order of ``schema``.
    Batches are cut into slices of bounded size first, so that long texts do not pile up.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, kind = make(*args), to_arrow_schema(out)
        for batch in batches:
            for part in slices(batch):
                got = f({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[x.name], type=x.type) for x in kind], schema=kind
                )

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most_bytes`` and at least one row."""
    n = batch.num_rows
    step = max(1, min(n, int(n * most_bytes / max(1, batch.nbytes))))
    for at in range(0, n, step):
        yield batch.slice(at, step)
