"""Row-local ``Column -> Column`` building blocks (no shuffle, no Python per row)."""

from stockloom.functions.arrays import (
    contains_all,
    drop_nulls,
    flags_to_labels,
    nested_size,
    stop_position,
    take_while,
)
from stockloom.functions.encoding import encode_ingredient, encode_offer, list_to_cell
from stockloom.functions.names import display_name, fallback_label, resolve_name
from stockloom.functions.numbers import (
    default_amount,
    equivalent_id,
    is_plausible_id,
    is_valid_reference,
    lenient_bool,
    lenient_int,
    lenient_long,
    sell_price,
)
from stockloom.functions.paths import (
    category_rank,
    file_name,
    file_stem,
    manifest_path,
    normalize_path,
    parse_numeric_id,
)
from stockloom.functions.text import (
    is_blank,
    normalize_category,
    normalize_condition,
    nullif_blank,
    special_currency_label,
)

__all__ = [
    "category_rank",
    "contains_all",
    "default_amount",
    "display_name",
    "drop_nulls",
    "encode_ingredient",
    "encode_offer",
    "equivalent_id",
    "fallback_label",
    "file_name",
    "file_stem",
    "flags_to_labels",
    "is_blank",
    "is_plausible_id",
    "is_valid_reference",
    "lenient_bool",
    "lenient_int",
    "lenient_long",
    "list_to_cell",
    "manifest_path",
    "nested_size",
    "normalize_category",
    "normalize_condition",
    "normalize_path",
    "nullif_blank",
    "parse_numeric_id",
    "resolve_name",
    "sell_price",
    "special_currency_label",
    "stop_position",
    "take_while",
]
