"""A PySpark-native engine for research-trace analytics."""
