"""barwright: a Spark-native analytics engine for OHLCV bar series."""
