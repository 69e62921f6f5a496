"""Tesserae: array, table and mesh analytics written as Spark DataFrame plans."""
