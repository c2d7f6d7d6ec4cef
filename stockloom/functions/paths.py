"""File-name and path rules of the asset manifest."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Asset categories with their file prefix and output folder.
ASSET_CATEGORIES: tuple[tuple[str, str, str], ...] = (
    ("item", "Item_", "items"),
    ("npc", "NPC_", "npcs"),
)
ASSET_EXTENSION = ".xnb"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(name: Column) -> Column:
    """File name without its last extension, in its original case."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def parse_numeric_id(name: Column, prefix: str, extension: str = ASSET_EXTENSION) -> Column:
    """Id in ``<prefix><digits><extension>`` (case-insensitive); null unless it fits an INT."""
    pattern = f"(?i)^{re.escape(prefix)}([0-9]+){re.escape(extension)}$"
    digits = F.regexp_extract(name, pattern, 1)
    # A failing try_cast costs an exception, so other names do not reach it.
    return F.when(digits != "", digits.try_cast("int"))


def manifest_path(folder: str | Column, stem: Column) -> Column:
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return F.concat(F.lit("sprites/"), folder, F.lit("/"), stem, F.lit(".png"))


def normalize_path(path: Column) -> Column:
    """Forward slashes, no leading slash."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def category_rank(category: Column) -> Column:
    return F.when(category == "item", 0).otherwise(1)
