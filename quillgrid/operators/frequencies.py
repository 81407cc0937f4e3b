"""Most frequent values, by counting each value once across the cluster."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.parsing import present


def most_frequent(frame: DataFrame, name: str, size: int = 1) -> DataFrame:
    """The top values with their counts; the smaller value wins a tie."""
    values = frame.select(present(frame, name).alias("value")).where("value is not null")
    return values.groupBy("value").count().orderBy(F.desc("count"), F.asc("value")).limit(size)


def mode_of(frame: DataFrame, name: str):
    top = most_frequent(frame, name).first()
    return None if top is None else top["value"]

