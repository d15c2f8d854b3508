"""Typed property graphs on Spark: extraction, resolution, graph analytics, serving queries and change data."""
