"""Spark-native analytics over corpora of source files, findings and documents."""
