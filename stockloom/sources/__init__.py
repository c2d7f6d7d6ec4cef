"""Readers. Schemas are always explicit; nothing is inferred."""

from stockloom.sources.arrays import as_typed, read_json_array
from stockloom.sources.files import list_assets, list_files, required_files, walk_files
from stockloom.sources.lines import read_lines
from stockloom.sources.tables import empty_table, path_exists, read_table

__all__ = [
    "as_typed",
    "empty_table",
    "list_assets",
    "list_files",
    "path_exists",
    "read_json_array",
    "read_lines",
    "read_table",
    "required_files",
    "walk_files",
]
