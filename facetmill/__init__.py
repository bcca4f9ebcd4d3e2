"""Catalog-scale analysis of B-rep parts and the data jobs around it, as Spark jobs."""
