"""Helpers shared by the operators: shared-folder tables, size estimates, stable 64-bit mixing, text chunking."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from capledger.sources.tables import kept, scratch  # noqa: F401 - operators take them from here

_U = np.uint64
M1, M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
GOLDEN = _U(0x9E3779B97F4A7C15)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage in a way that survives lost executors."""
    return kept(df, scratch(df.sparkSession, name))


def input_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of a plan, None where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 55 else None


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows on the driver as a local relation, whose true size the optimizer knows: joined to a large table it is broadcast if it is small, without a shuffle of the other."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    cols = list(zip(*rows)) if rows else [()] * len(arrow)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow), schema=kind)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * M1
        x = (x ^ (x >> _U(27))) * M2
        return x ^ (x >> _U(31))


def batches_by_chars(batch: pa.RecordBatch, text_at: int, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes at most (one row at least)."""
    col = batch.column(text_at)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    at, n = 0, batch.num_rows
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield at, to
        at = to
