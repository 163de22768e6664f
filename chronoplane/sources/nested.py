"""Nested odds payloads to rows, and rows of markets to one line per player."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Payload schema and market names.
PAYLOAD_DDL = (
    "id string, sport_key string, commence_time string, home_team string, away_team string, "
    "bookmakers array<struct<key: string, title: string, markets: array<struct<key: string, "
    "outcomes: array<struct<name: string, description: string, price: int, point: double>>>>>>"
)
MARKETS = ("player_points", "player_rebounds", "player_assists")


def flatten_nested(df: DataFrame, payload: str | None = None, schema: str = PAYLOAD_DDL) -> DataFrame:
    """One row per quoted outcome; an outcome without a player is left out.

    `payload` names a JSON text column; without it the columns are already nested.
    """
    if payload:
        df = df.select(F.from_json(payload, schema).alias("p")).select("p.*")
    books = df.select(F.col("id").alias("event_id"), F.explode("bookmakers").alias("b"))
    markets = books.select("event_id", F.col("b.key").alias("bookmaker"), F.explode("b.markets").alias("m"))
    quotes = markets.select("event_id", "bookmaker", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o"))
    return quotes.select(
        "event_id",
        "bookmaker",
        "market",
        F.col("o.description").alias("player_name"),
        F.col("o.name").alias("over_under"),
        F.col("o.point").alias("line"),
        F.col("o.price").alias("odds"),
    ).filter(F.coalesce(F.col("player_name"), F.lit("")) != "")


def pivot_lines(quotes: DataFrame, order, markets=MARKETS, default_odds: int = -110) -> DataFrame:
    """Per event, player and source: one column per market (first over line), their sum, the first market's odds.

    The markets are a fixed list, so the pivot is one aggregate; only complete rows are kept.
    """
    at = F.struct(*[F.col(c) for c in order])
    over = quotes.filter(F.col("over_under") == "Over")
    key = ["event_id", "player_name", "bookmaker"]

    def first(value: str, market: str):
        hit = (F.col("market") == market) & F.col(value).isNotNull()
        return F.min_by(F.col(value), F.when(hit, at))

    wide = over.groupBy(*key).agg(
        *[first("line", m).alias(m) for m in markets], first("odds", markets[0]).alias("total_odds")
    )
    whole = wide.dropna(subset=list(markets))
    total = sum((F.col(m) for m in markets[1:]), F.col(markets[0]))
    return whole.withColumns(
        {"total_line": total, "total_odds": F.coalesce("total_odds", F.lit(default_odds))}
    )
