"""Continuous settlement of bets from a stream of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoplane.keys import as_tuple
from chronoplane.operators.ledger import settled_columns
from chronoplane.streaming.ingest import event_stream, write_batches

#: Which result a settled row comes from: its order among the results of a key.
RESULT = "__result"


def stream_ledger(results: DataFrame, ledger_path: str, settled_path: str, checkpoint: str,
                  key=("player_name", "bet_date"), newest: str | None = None,
                  once: bool = True) -> StreamingQuery:
    """Settle pending bets as bets and results arrive, in whatever order; each batch writes to its own folder.

    The ledger is read as a stream too and joined with the stream of results by key. The join keeps both sides, row by
    row, in its state: a result waits for bets that come after it, a bet meets every correction of its result, and a
    batch looks up its own keys only. Each pair of a bet and a result makes one row; `settled_bets` takes the row of
    the newest result. A result that arrives again changes nothing.

    Of several results for a key the one with the largest `newest` counts (without it, the one that arrived in the
    last batch), of these the largest. A result without a value leaves its bets pending. Rows with a NULL in the key
    meet nothing. The ledger must hold a file when the stream starts.
    """
    spark = results.sparkSession
    key = list(as_tuple(key))
    order = F.col(newest) if newest else F.current_timestamp()
    versions = results.select(*key, order.alias("__newest"), F.col("actual").alias("__a")).dropDuplicates()
    bets = event_stream(spark, ledger_path, spark.read.parquet(ledger_path).schema).filter(F.col("status") == "pending")
    pairs = bets.join(versions, key, "inner").withColumn(RESULT, F.struct("__newest", "__a"))
    return write_batches(settled_columns(pairs).drop("__newest"), settled_path, checkpoint, once)


def settled_bets(spark: SparkSession, settled_path: str, key=("player_name", "bet_date")) -> DataFrame:
    """Each settled bet once, by the newest result of its key."""
    key = list(as_tuple(key))
    rows = spark.read.parquet(settled_path).drop("batch")
    newest = rows.groupBy(*key).agg(F.max(RESULT).alias("__last"))
    last = rows.join(newest, key).filter(F.col(RESULT).eqNullSafe(F.col("__last")))
    return last.drop(RESULT, "__last")
