"""Measurement-table analytics on Spark."""
