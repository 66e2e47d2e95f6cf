"""Broadcast hints that need a proof of size."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest side we are willing to ship to every executor.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

_FIXED_WIDTH = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


def _vector_bytes(field: T.StructField) -> int | None:
    """Bytes of a dense vector whose metadata states its length."""
    length = field.metadata.get("ml_attr", {}).get("num_attrs")
    return 8 * length + 64 if isinstance(field.dataType, VectorUDT) and length is not None else None


def row_width(schema: T.StructType) -> int | None:
    """Bytes of one unsafe row, or None when a column has no known width."""
    words = len(schema.fields)
    width = 8 * words + 8 * ((words + 63) // 64) + 16
    for f in schema.fields:
        if not isinstance(f.dataType, _FIXED_WIDTH):
            extra = _vector_bytes(f)
            if extra is None:
                return None
            width += extra
    return width


def broadcast_if_bounded(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Hint a broadcast when ``max_rows`` is a proven bound and the bytes fit.

    Without a bound, with a variable-width column, or above the limit the relation is
    returned as it is: the join is then a shuffle join that AQE may still turn into a
    broadcast from measured sizes, or split where a key is hot.
    """
    if max_rows is None:
        return df
    width = row_width(df.schema)
    if width is None or width * max_rows > BROADCAST_LIMIT_BYTES:
        return df
    return F.broadcast(df)
