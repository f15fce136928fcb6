"""Property-valuation analytics as PySpark DataFrame jobs."""
