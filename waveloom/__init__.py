"""waveloom: a Spark-native toolkit for learned signal compression and corpus preparation."""

__version__ = "0.1.0"
