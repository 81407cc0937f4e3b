"""Calendar totals kept up to date while files of rows keep arriving."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgrid.operators.timeseries import bucket_end


def running_totals(stream: DataFrame, moment: str, value: Column, frequency: str, late: str | None = None) -> DataFrame:
    """Row count and total per calendar bucket of a stream.

    State is one row per bucket. With `late`, rows older than the watermark are left
    out and buckets behind it can be dropped from state.
    """
    rows = stream.withColumn("_moment", F.col(moment).cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark("_moment", late)
    return rows.groupBy(bucket_end(F.col("_moment"), frequency).alias("period")).agg(
        F.count("*").alias("rows"), F.sum(value).alias("total")
    )


def keep_table(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the current totals after every batch; stops when the known files are done."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        totals.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
