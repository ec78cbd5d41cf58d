"""Loci: a Spark-native memory analytics engine."""

__version__ = "0.1.0"
