"""Retail lakehouse pipeline written as Spark DataFrame jobs."""
