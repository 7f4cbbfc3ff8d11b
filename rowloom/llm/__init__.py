"""Training-data pipeline operators. Nothing else in ``rowloom`` imports this package."""
