"""Bibliographic catalogue curation and analytics as Spark DataFrame operators."""
