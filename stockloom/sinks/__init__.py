"""Writers: JSON lines and CSV folders for data of any size, single text files for reports."""

from stockloom.sinks.csv import flatten_for_csv, write_csv_flat
from stockloom.sinks.json import public_names, write_json
from stockloom.sinks.named import write_named_files
from stockloom.sinks.placeholder import write_placeholder
from stockloom.sinks.run_log import append_run_log, parse_run_log, read_run_log
from stockloom.sinks.text import write_text_file

__all__ = [
    "append_run_log",
    "flatten_for_csv",
    "parse_run_log",
    "public_names",
    "read_run_log",
    "write_csv_flat",
    "write_json",
    "write_named_files",
    "write_placeholder",
    "write_text_file",
]
