"""siltlog: a PySpark-native analytics engine for append-only key/value logs."""
