"""A PySpark-native engine for bulk file-verdict analytics."""
