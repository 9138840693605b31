"""Sources and sinks: Parquet tables, JSON lines, query sets."""
