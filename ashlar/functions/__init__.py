"""Scalar and aggregate functions."""

from ashlar.functions import aggregates, dates, numeric, strings

__all__ = ["aggregates", "dates", "numeric", "strings"]
