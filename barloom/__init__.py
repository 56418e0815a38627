"""A PySpark-native research engine for bar and tick time series."""
