"""Market-data, trade and experiment analytics as PySpark DataFrame operators."""
