"""Retail price and nutrition comparison catalog, expressed as Spark jobs."""
