"""plexivec: Spark-native analytics over weighted collections of sequences and vectors."""

__version__ = "0.1.0"
