"""A PySpark-native analytics engine for news-style and training-data content."""
