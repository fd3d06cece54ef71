"""Spark-native document structure engine: layout, Markdown, law text, tables, job catalog, data quality."""
