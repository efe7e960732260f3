"""Tessera: retrieval, knowledge and corpus analytics as PySpark DataFrame operators."""
