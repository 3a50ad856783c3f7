"""Tidalbook: a Spark-native ledger analytics engine."""
