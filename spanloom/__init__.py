"""Spanloom: analytics over relay latency traces as plain Spark DataFrame plans."""
