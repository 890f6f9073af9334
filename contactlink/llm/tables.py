"""Small helpers that the operators of this package share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def extras(df: DataFrame, own: list[str]) -> list[str]:
    """Columns of ``df`` that an operator passes through: all but those it makes itself (names compared without case)."""
    taken = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in taken]


def exact(name: str) -> Column:
    """The column of that literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed_rest(df: DataFrame, own: list[str], name: str = "_rest") -> tuple[Column, list[str]]:
    """The passed-through columns as one struct column, so that no name can clash inside an operator."""
    names = extras(df, own)
    fields = [exact(c).alias(f"c{i}") for i, c in enumerate(names)]
    return F.struct(*(fields or [F.lit(None).cast("int").alias("none")])).alias(name), names


def unpacked_rest(names: list[str], name: str = "_rest") -> list[Column]:
    return [F.col(f"{name}.c{i}").alias(c) for i, c in enumerate(names)]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def arrow_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def field_type(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of the id: the same ones at every partitioning."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(20)), F.col(id_col)).limit(rows)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
