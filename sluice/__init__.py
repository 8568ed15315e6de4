"""sluice: a PySpark-native analytics engine (DataFrame first, Catalyst planned)."""

__version__ = "0.1.0"
