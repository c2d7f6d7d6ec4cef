"""Name resolution with fallback chains.

Each dataset has its own chain; all are instances of :func:`resolve_name`:

=============  ==========================================  ==================
recipe item    name                                        ``ItemID.<id>``
edge item      localized name, internal name               ``Item_<id>``
vendor item    name without the bad prefix, internal name  ``Item <id>``
vendor         localized name, internal name               ``NPC <id>``
item asset     internal name                               ``Item_<id>``
npc asset      (none)                                      ``NPC_<id>``
station        tile name                                   ``TileID.<id>``
=============  ==========================================  ==================
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockloom.functions.text import is_blank, nullif_blank

# Marker of an unlocalised name and the label written before an id.
UNLOCALIZED_PREFIX = "ItemName."
RECIPE_ITEM_LABEL = "ItemID."
EDGE_ITEM_LABEL = "Item_"
VENDOR_ITEM_LABEL = "Item "
VENDOR_LABEL = "NPC "
NPC_ASSET_LABEL = "NPC_"
STATION_LABEL = "TileID."


def fallback_label(prefix: str, id_col: Column) -> Column:
    return F.concat(F.lit(prefix), id_col.cast("string"))


def resolve_name(
    *candidates: Column, label: str, id_col: Column, bad_prefix: str | None = None
) -> Column:
    """First non-blank candidate, else ``label`` followed by the id.

    ``bad_prefix`` disqualifies only the first candidate (case-sensitive).
    """
    usable = [nullif_blank(c) for c in candidates]
    if bad_prefix is not None and usable:
        usable[0] = F.when(~candidates[0].startswith(bad_prefix), usable[0])
    return F.coalesce(*usable, fallback_label(label, id_col))


def display_name(name: Column, fallback: Column, bad_prefix: str = UNLOCALIZED_PREFIX) -> Column:
    """Name, or the fallback when it is blank or unlocalised; null ends as ``''``."""
    chosen = F.when(is_blank(name) | name.startswith(bad_prefix), fallback).otherwise(name)
    return F.coalesce(chosen, F.lit(""))
