"""Lumenfold: Spark-first tables and rules for agent life-simulation data."""
