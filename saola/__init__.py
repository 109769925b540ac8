"""Spark-native analytics over noisy Vietnamese text: filters, normalisation, synthetic errors, correction, scoring."""
