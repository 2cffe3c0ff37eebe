"""Operators over trace tables: pairing, interval rules, correlation."""
