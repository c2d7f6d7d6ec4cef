"""Text normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal spellings a condition may use for the acting player, and the short form.
PLAYER_SPELLINGS: tuple[tuple[str, str], ...] = (
    ("Main.player[Main.myPlayer].", "player."),
    ("Main.LocalPlayer.", "player."),
)


# The characters with the Unicode White_Space property, as a list and as a pattern, and
# four ASCII separators that only some rules treat as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SEPARATORS = "\x1c\x1d\x1e\x1f"


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text (Unicode whitespace counts)."""
    return text.isNull() | (strip_whitespace(text) == "")


def nullif_blank(text: Column) -> Column:
    return F.when(~is_blank(text), text)


def strip_whitespace(text: Column, extra: str = "") -> Column:
    """Trim Unicode whitespace at both ends; a plain ``F.trim`` only removes spaces."""
    return F.trim(text, F.lit(WHITESPACE + extra))


def normalize_condition(
    text: Column, replacements: Sequence[tuple[str, str]] = PLAYER_SPELLINGS
) -> Column:
    """Trim, apply literal replacements in order, collapse whitespace runs; blank gives ``''``."""
    out = strip_whitespace(text)
    for old, new in replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.coalesce(F.regexp_replace(out, f"{WHITESPACE_CLASS}+", " "), F.lit(""))


def normalize_category(text: Column) -> Column:
    """Lower-cased and stripped; the ASCII separators 0x1C-0x1F count as whitespace here."""
    return F.lower(strip_whitespace(F.coalesce(text, F.lit("")), SEPARATORS))


def special_currency_label(currency: Column) -> Column:
    """``specialCurrency=<n>`` for n >= 0, else null."""
    return F.when(currency >= 0, F.concat(F.lit("specialCurrency="), currency.cast("string")))
