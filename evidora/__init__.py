"""A PySpark engine for layered document graphs and evidence retrieval."""
