"""Training-data pipeline operators (optional subpackage)."""
