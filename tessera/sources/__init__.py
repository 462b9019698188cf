"""Sources: parquet tables, derived inputs and the CSV scan."""
