"""Text and Parquet sinks."""
