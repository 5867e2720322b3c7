"""Document-library analytics on Spark: identifiers, page metadata, search, categories, imports."""
