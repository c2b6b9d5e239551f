"""Document-to-ledger analytics on PySpark."""
