"""A PySpark-native engine for hybrid retrieval and retrieval analytics."""
