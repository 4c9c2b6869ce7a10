"""Loamline: analytics over source repositories, written as Spark jobs."""
