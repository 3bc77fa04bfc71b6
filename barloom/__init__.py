"""A Spark-native engine for research on OHLCV bar series and forecast samples."""
