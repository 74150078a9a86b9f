"""Writers whose results are whole or absent: the committer renames finished files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def parquet(df: DataFrame, path: str, *by: str) -> None:
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """Arrays, maps and structs become JSON text."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def finite(col: Column, kind: DataType) -> Column:
    """The column with NaN and infinities as null, inside arrays, maps and structs too."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)
    if isinstance(kind, ArrayType):
        return F.transform(col, lambda x: finite(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(col, lambda _, v: finite(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(col.isNotNull(), F.struct(*[finite(col[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return col


def json_lines(df: DataFrame, path: str) -> None:
    """NaN and infinities are written as null."""
    df.select(*[finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]).write.mode("overwrite").json(path)
