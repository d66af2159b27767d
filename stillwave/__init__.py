"""PySpark-native analytics for continuous multi-station sensor recordings."""
