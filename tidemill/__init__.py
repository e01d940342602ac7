"""Incremental relational analytics on PySpark: batch and changelog forms of the same operators."""
