"""Spark-native engine for noisy event listings: extract, normalise, resolve, store, query."""
