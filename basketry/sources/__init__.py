"""Sources and sinks: Parquet tables, adapter views, CSV / JSON / landed files."""
