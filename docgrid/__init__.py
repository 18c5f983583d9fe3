"""docgrid: a PySpark-native engine for extracting, reconciling and querying technical document corpora."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
