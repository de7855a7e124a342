"""A PySpark-native engine for corpus memory: prepare, deduplicate, tag, search and distil tables of text."""
