"""ashlar: a PySpark-native analytics engine (fluent frames, exact operator semantics, industrial statistics)."""

from ashlar.session import get_spark

__all__ = ["get_spark"]
