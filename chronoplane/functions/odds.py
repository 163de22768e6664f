"""Quoted odds, edges and stakes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default odds, stake fraction, least edge, least confidence and largest relative deviation
# of the two decision rules, stabiliser of the relative deviation.
DEFAULT_ODDS = -110
STAKE_FRACTION = 0.25
MIN_EDGE = 0.03
MIN_CONFIDENCE = 0.6
MAX_CV = 0.35
CV_EPSILON = 1e-6


def as_column(x) -> Column:
    if isinstance(x, str):
        return F.col(x)
    return x if isinstance(x, Column) else F.lit(x)


def american_to_probability(odds) -> Column:
    """Break-even probability; odds of zero are an error."""
    o = as_column(odds).cast("double")
    return (
        F.when(o == 0, F.raise_error(F.lit("odds must not be zero")).cast("double"))
        .when(o < 0, -o / (-o + 100))
        .otherwise(100 / (o + 100))
    )


def payoff(odds) -> Column:
    """Profit per unit staked on a win."""
    o = as_column(odds).cast("double")
    return (
        F.when(o == 0, F.raise_error(F.lit("odds must not be zero")).cast("double"))
        .when(o < 0, 100 / -o)
        .otherwise(o / 100)
    )


def edge(prob, odds=DEFAULT_ODDS) -> Column:
    return as_column(prob) - american_to_probability(odds)


def full_stake(prob, odds=DEFAULT_ODDS) -> Column:
    """Growth-optimal share of the bankroll; negative without an edge."""
    p, b = as_column(prob), payoff(odds)
    return (p * b - (1 - p)) / b


def kelly_size(prob, odds=DEFAULT_ODDS, fraction: float = STAKE_FRACTION, min_edge: float = MIN_EDGE) -> Column:
    """Fraction of the growth-optimal stake: 0 below the least edge, at most `fraction`."""
    e = as_column(prob) - 1 / (1 + payoff(odds))
    size = F.least(F.greatest(full_stake(prob, odds) * fraction, F.lit(0.0)), F.lit(float(fraction)))
    return F.when(as_column(prob).isNull(), F.lit(None)).when(e >= min_edge, size).otherwise(F.lit(0.0))


def kelly_uncapped(prob, odds=DEFAULT_ODDS, fraction: float = STAKE_FRACTION) -> Column:
    """Fraction of the growth-optimal stake, floored at zero only."""
    return F.greatest(full_stake(prob, odds) * fraction, F.lit(0.0))


def confidence(prob) -> Column:
    return F.abs(as_column(prob) - 0.5) / 0.5


def relative_deviation(std, mean) -> Column:
    return as_column(std) / (as_column(mean) + CV_EPSILON)


def passes_confidence(prob, std, mean, least: float = 0.7, max_cv: float = 0.30) -> Column:
    ok = (confidence(prob) >= least) & (relative_deviation(std, mean) <= max_cv)
    return F.coalesce(ok, F.lit(False))


def expected_value(prob, odds=DEFAULT_ODDS) -> Column:
    p = as_column(prob)
    return p * payoff(odds) - (1 - p)


def bet_strength(edge_col, confidence_col) -> Column:
    """Thresholds of the three strengths."""
    e, c = as_column(edge_col), as_column(confidence_col)
    return (
        F.when((e >= 0.15) & (c >= 0.85), "STRONG").when((e >= 0.10) & (c >= 0.75), "GOOD").otherwise("OK")
    )
