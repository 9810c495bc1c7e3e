"""Storage: evaluation tables as Parquet and Arrow streams, CSV reports."""
