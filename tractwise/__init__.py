"""Motif, interval, measurement-table and variant analytics as Spark jobs."""
