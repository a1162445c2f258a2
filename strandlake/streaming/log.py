"""The append log as a stream: each micro-batch becomes a generation, replays are recognised by batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import newest


def follow(spark: SparkSession, source: str, schema: str, state: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet files arriving in `source` (genome_id, op, value, generation) are reduced to the newest row of each genome in a
    batch and written under `state`/batch=<id>; a batch that is replayed after a failure overwrites its own folder."""

    def put(batch: DataFrame, batch_id: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, state: str) -> DataFrame:
    """Newest row of each genome over all batches; removed ones are left out."""
    return newest(spark.read.parquet(state).drop("batch")).where("op <> 'remove'")


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    """Events of each key in tumbling windows, with late data up to `delay`."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
