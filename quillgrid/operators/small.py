"""Small driver-side results as DataFrames (schema first, rows bounded by columns)."""

from collections.abc import Iterable, Sequence
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def small_frame(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    struct = T.StructType.fromDDL(schema)
    rows = list(rows)
    arrow_types = {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
        "boolean": pa.bool_(), "date": pa.date32(), "array<string>": pa.list_(pa.string()),
        "map<string,string>": pa.map_(pa.string(), pa.string()),
    }
    arrays = [
        pa.array([r[i] for r in rows], type=arrow_types[f.dataType.simpleString()])
        for i, f in enumerate(struct.fields)
    ]
    table = pa.Table.from_arrays(arrays, names=struct.names)
    return spark.createDataFrame(table).select(*["`" + n + "`" for n in struct.names])


def half_up(value: float | None, digits: int) -> float | None:
    """Round a driver value the way `F.round` rounds a column."""
    if value is None:
        return None
    return float(Decimal(repr(float(value))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
