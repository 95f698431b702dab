"""Ledger analytics as PySpark DataFrame operators."""
