"""Scans and sinks."""

from .readers import (table, read_csv, read_csv_with_fallback, resolve_column,
                      load_mapping, read_text_lines, text_lines, file_hashes)
from .sinks import write_table, write_csv, write_json, append_ledger

__all__ = ["table", "read_csv", "read_csv_with_fallback", "resolve_column",
           "load_mapping", "read_text_lines", "text_lines", "file_hashes",
           "write_table", "write_csv", "write_json", "append_ledger"]
