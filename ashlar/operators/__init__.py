"""Relational operators."""

from ashlar.operators.frame import Frame

__all__ = ["Frame"]
