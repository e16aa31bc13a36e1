"""Value-discovery boards as PySpark DataFrame transformations."""
