"""Continuous ingest of event files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chronoplane.keys import as_tuple

#: Keys outlive any memory, so they lie in RocksDB, and a batch adds only its own changes to the checkpoint.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Counting the keys of the state, a figure of its progress only, takes a look-up before each write.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def event_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None,
                 files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


@contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; a stream takes its settings when it starts."""
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def write_batches(stream: DataFrame, path: str, checkpoint: str, once: bool) -> StreamingQuery:
    """Each batch of the stream in a folder of its own, which a batch that runs again after a failure overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    with large_state(stream.sparkSession):
        return writer.start()


def stream_ingest(stream: DataFrame, path: str, checkpoint: str, grain, once: bool = True) -> StreamingQuery:
    """Each key once, however late its other rows arrive; a batch writes the keys that are new to its own folder.

    The keys seen are the stream's state, dealt out by key: a batch looks up its own keys only, and reads nothing that
    is stored. There is no watermark, so no row is dropped for being late and no key is forgotten. Of several rows for
    a key any one is kept; NULL is a key like others. State and folders belong together: a new checkpoint needs a new
    `path`. `once` takes what is there and stops.
    """
    return write_batches(stream.dropDuplicates(list(as_tuple(grain))), path, checkpoint, once)
