"""Quarrylane: a Spark-native engine for evaluation and dataset analytics."""
