"""Public-ledger analytics expressed as Spark DataFrame plans."""
