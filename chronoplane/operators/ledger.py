"""Bets kept as append-only rows; settling is a join, so nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.keys import as_tuple

# Ledger columns in order, payout per unit on a win.
LEDGER_COLUMNS = (
    "bet_date",
    "timestamp",
    "player_name",
    "team_abbreviation",
    "opponent",
    "betting_line",
    "direction",
    "mean_pred",
    "std_dev",
    "prob_win",
    "edge",
    "kelly_size",
    "confidence_score",
    "bookmaker",
    "status",
    "actual",
)
LEDGER_PAYOUT = 0.91


def ledger_entries(bets: DataFrame, bet_date: Column | None = None, written: Column | None = None, keep=()) -> DataFrame:
    """Bets as pending ledger rows with the ledger columns they have, plus `keep`."""
    defaults = {
        "bet_date": F.current_date() if bet_date is None else bet_date,
        "timestamp": F.current_timestamp() if written is None else written,
        "status": F.lit("pending"),
        "actual": F.lit(None).cast("double"),
    }
    out = bets.withColumns({n: c for n, c in defaults.items() if n not in bets.columns})
    return out.select(*as_tuple(keep), *[c for c in LEDGER_COLUMNS if c in out.columns])


def ledger_append(bets: DataFrame, path: str, bet_date: Column | None = None, written: Column | None = None, keep=()) -> None:
    """Append pending bets to the stored ledger.

    An append holds one or a few bet dates, so the files' own statistics already prune by date; folders per
    date would only make many small files.
    """
    ledger_entries(bets, bet_date, written, keep).write.mode("append").parquet(path)


def ledger_settle(ledger: DataFrame, results: DataFrame, key=("player_name", "bet_date"), actual: str = "actual") -> DataFrame:
    """Ledger with results filled in and pending bets set to won or lost; a push goes to the under.

    `results` has one row per key.
    """
    key = list(as_tuple(key))
    side = results.select(*key, F.col(actual).alias("__a"))
    return settled_columns(ledger.join(side, key, "left"))


def settled_columns(joined: DataFrame) -> DataFrame:
    """Status and result of bets that carry the result of their key, or NULL, as `__a`."""
    won = F.when(F.col("direction") == "OVER", F.col("__a") > F.col("betting_line")).otherwise(
        F.col("__a") <= F.col("betting_line")
    )
    status = F.when(F.col("__a").isNull(), F.col("status")).when(won, "won").otherwise("lost")
    return joined.withColumns({"status": status, "actual": F.coalesce("__a", "actual")}).drop("__a")


def ledger_summary(ledger: DataFrame, payout: float = LEDGER_PAYOUT) -> DataFrame:
    """Counts, win rate and stake-weighted return of the settled bets."""
    won, lost = F.col("status") == "won", F.col("status") == "lost"
    done = won | lost
    k = F.col("kelly_size")
    one = ledger.agg(
        F.count(F.lit(1)).alias("total_bets"),
        F.count_if(done).alias("completed_bets"),
        F.count_if(F.col("status") == "pending").alias("pending_bets"),
        F.count_if(won).alias("wins"),
        F.count_if(lost).alias("losses"),
        F.sum(F.when(won, k * payout).when(lost, -k)).alias("total_profit"),
        F.sum(F.when(done, k)).alias("__wagered"),
        F.avg(F.when(done, F.col("edge"))).alias("avg_edge"),
        F.avg(F.when(done, k)).alias("avg_kelly_size"),
    )
    settled = F.col("completed_bets") > 0
    roi = F.when(F.col("__wagered") > 0, F.col("total_profit") / F.col("__wagered") * 100).otherwise(F.lit(0.0))
    return one.withColumns(
        {"win_rate": F.col("wins") / F.nullif(F.col("completed_bets"), F.lit(0)), "roi": F.when(settled, roi)}
    ).drop("__wagered")
