"""Spark-native contracts, operators and queries for recorded-match trajectories."""

__version__ = "0.1.0"
