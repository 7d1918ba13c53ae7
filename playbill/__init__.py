"""Catalog and ratings analytics as PySpark DataFrame operators."""
