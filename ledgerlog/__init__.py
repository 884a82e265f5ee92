"""A PySpark-native engine for append-only, timestamp-ordered log data."""
