"""A PySpark-native engine for building and querying knowledge bases of documents."""
