"""A PySpark-native engine for text-corpus analytics."""
