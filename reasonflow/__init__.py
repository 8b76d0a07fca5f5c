"""A PySpark engine for chain-of-thought reasoning data."""
