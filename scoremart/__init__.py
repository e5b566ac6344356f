"""PySpark-native processing of benchmark-evaluation results."""
