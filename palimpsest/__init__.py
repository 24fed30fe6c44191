"""Palimpsest: a PySpark-native analytics engine for long-lived assistant memory."""
