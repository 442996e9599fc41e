"""Join helpers: broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (an upper bound for scans)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size if isinstance(size, int) else size.toString())
    except Exception:  # pragma: no cover - estimate unavailable
        return None


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left",
               max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Join ``small`` into ``big``; broadcast it only when its estimated size is bounded.

    Above the bound the plan stays a shuffle join (AQE may still switch it at run
    time from measured stage sizes).
    """
    size = estimated_bytes(small)
    if size is not None and size <= max_bytes:
        small = F.broadcast(small)
    return big.join(small, on, how)


def local_rows(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A frame of a few rows on the driver whose size the planner knows. That of ``createDataFrame``
    of tuples counts as unlimited, so a join with it may broadcast the other side, however
    many rows its compressed files hold."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    table = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)
