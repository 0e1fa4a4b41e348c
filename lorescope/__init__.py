"""Catalog metadata search, change detection and profiling as plain Spark jobs."""
