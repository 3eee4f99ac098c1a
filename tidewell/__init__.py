"""Tidewell: barcoded-measurement analytics as PySpark DataFrame jobs."""
