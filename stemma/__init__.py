"""A Spark-native engine for literature collections and text corpora."""
