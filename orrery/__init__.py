"""Orrery: market-cycle and training-data analytics as composable Spark DataFrame operators."""
