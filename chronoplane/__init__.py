"""Leak-free temporal features, splits, scoring and decision evaluation on Spark."""

from chronoplane.keys import Keys

__all__ = ["Keys"]
