"""Sources and sinks: the Parquet lake, JSON files, patch stores, search servers, synthetic data."""
