"""A PySpark-native engine for mail archives and training data."""
