"""From predictions and quoted lines to decisions and their outcomes. Row expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.functions import odds as O

# Profit per unit on a win and on a loss; confidence and deviation limits of the daily rule.
WIN_PROFIT, LOSS_PROFIT = 0.909, -1.0
BREAK_EVEN_RATE = 0.524


def bet_decision_point(df: DataFrame, prediction: str, line: str) -> DataFrame:
    """Over where the prediction is above the line; edge is their distance. A missing line is no over."""
    diff = F.col(prediction) - F.col(line)
    return df.withColumns(
        {"bet_over": F.coalesce(diff > 0, F.lit(False)), "edge_size": F.abs(diff)}
    )


def bet_outcome(df: DataFrame, actual: str, line: str, decision: str = "bet_over",
                win: float = WIN_PROFIT, loss: float = LOSS_PROFIT) -> DataFrame:
    """Correctness and profit. Reaching the line exactly counts for the under; no line, no profit."""
    over = F.coalesce(F.col(actual) > F.col(line), F.lit(False))
    correct = over == F.col(decision)
    profit = F.when(F.col(line).isNull(), 0.0).when(correct, F.lit(win)).otherwise(F.lit(loss))
    return df.withColumns({"has_line": F.col(line).isNotNull(), "bet_correct": correct, "profit": profit})


def expected_value(df: DataFrame, prob_over: str, odds=O.DEFAULT_ODDS) -> DataFrame:
    p = F.col(prob_over)
    return df.withColumns({"ev_over": O.expected_value(p, odds), "ev_under": O.expected_value(1 - p, odds)})


def confidence_filter(df: DataFrame, prob_over: str, std: str, mean: str, least: float = 0.7, max_cv: float = 0.30) -> DataFrame:
    """Rows whose probability is far from one half and whose deviation is small against the mean."""
    return df.filter(O.passes_confidence(F.col(prob_over), F.col(std), F.col(mean), least, max_cv))


def bet_decision_prob(df: DataFrame, prob_over: str, std: str, mean: str, odds=O.DEFAULT_ODDS,
                      fraction: float = O.STAKE_FRACTION, min_edge: float = O.MIN_EDGE,
                      min_confidence: float = O.MIN_CONFIDENCE, max_cv: float = O.MAX_CV) -> DataFrame:
    """Edge, stake and decision for both sides of the line."""
    p = F.col(prob_over)
    sides = {"over": p, "under": 1 - p}
    ok = O.passes_confidence(p, F.col(std), F.col(mean), min_confidence, max_cv)
    cols: dict[str, Column] = {"prob_under": 1 - p}
    for side, prob in sides.items():
        e = O.edge(prob, odds)
        stake = O.kelly_size(prob, odds, fraction, min_edge)
        bet = F.coalesce(e >= min_edge, F.lit(False)) & ok
        cols[f"edge_{side}"] = e
        cols[f"kelly_size_{side}"] = stake
        cols[f"should_bet_{side}"] = bet
        cols[f"bet_size_{side}"] = F.when(bet, stake).otherwise(F.lit(0.0))
    cols["confidence_score"] = O.confidence(p)
    cols["cv"] = O.relative_deviation(F.col(std), F.col(mean))
    return df.withColumns(cols)


def bet_decision_best(df: DataFrame, prob_over: str, std: str, mean: str, odds=O.DEFAULT_ODDS,
                      fraction: float = O.STAKE_FRACTION, min_edge: float = O.MIN_EDGE,
                      min_confidence: float = O.MIN_CONFIDENCE, max_cv: float = O.MAX_CV) -> DataFrame:
    """One row per bet worth making, with the better side; equal edges go under.

    Edge and confidence columns that the input already has are used as they are.
    """
    p = F.col(prob_over)
    given = {
        "edge_over": O.edge(p, odds),
        "edge_under": O.edge(1 - p, odds),
        "confidence_score": O.confidence(p),
    }
    out = df.withColumns({n: c for n, c in given.items() if n not in df.columns})
    cv = O.relative_deviation(F.col(std), F.col(mean))
    ok = (F.col("confidence_score") >= min_confidence) & (cv <= max_cv)
    over = ok & (F.col("edge_over") >= min_edge)
    under = ok & (F.col("edge_under") >= min_edge)
    take_over = over & (~under | (F.col("edge_over") > F.col("edge_under")))
    side = F.when(take_over, "OVER").when(under, "UNDER")
    out = out.withColumns({"cv": cv, "direction": side}).filter(F.col("direction").isNotNull())
    is_over = F.col("direction") == "OVER"
    prob_win = F.when(is_over, p).otherwise(1 - p)
    return out.withColumns(
        {
            "edge": F.when(is_over, F.col("edge_over")).otherwise(F.col("edge_under")),
            "prob_win": prob_win,
            "kelly_size": O.kelly_size(prob_win, odds, fraction, min_edge),
        }
    )


def recommend(df: DataFrame, min_edge: float, min_confidence: float, max_cv: float) -> DataFrame:
    """Looser form: the larger edge decides the side, then edge, confidence and deviation filter."""
    over = F.col("edge_over") > F.col("edge_under")
    out = df.withColumns(
        {
            "direction": F.when(over, "OVER").otherwise("UNDER"),
            "edge": F.when(over, F.col("edge_over")).otherwise(F.col("edge_under")),
            "prob_win": F.when(over, F.col("prob_over")).otherwise(1 - F.col("prob_over")),
        }
    )
    return out.filter(
        (F.col("edge") >= min_edge) & (F.col("confidence_score") >= min_confidence) & (F.col("cv") <= max_cv)
    ).withColumn("strength", O.bet_strength("edge", "confidence_score"))
