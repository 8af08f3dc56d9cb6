"""Sources and sinks."""

from kindling.sources.io import load_model, read_table, save_model, write_csv, write_report

__all__ = ["read_table", "write_csv", "write_report", "save_model", "load_model"]
