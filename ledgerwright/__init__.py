"""Usage-ledger analytics as PySpark DataFrame transformations."""
