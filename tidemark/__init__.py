"""Market-data and event analytics as PySpark DataFrame transformations."""
