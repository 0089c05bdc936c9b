"""Tessera: relational and training-data operators written as PySpark DataFrame jobs."""
