"""Keyed-table analytics on Spark: tables, accumulators, supersteps, text and URL functions."""
