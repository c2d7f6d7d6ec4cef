"""Schemas of the catalog datasets and of the tables they are derived from."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    IntegerType,
    LongType,
    StringType,
    StructType,
)

INT, LONG, TEXT, BOOL = IntegerType(), LongType(), StringType(), BooleanType()

# Recipe flag columns and the label each one turns into, in output order.
RECIPE_FLAGS: tuple[tuple[str, str], ...] = (
    ("need_water", "Water"),
    ("need_lava", "Lava"),
    ("need_honey", "Honey"),
    ("need_snow_biome", "SnowBiome"),
    ("need_graveyard_biome", "GraveyardBiome"),
    ("need_everything_seed", "EverythingSeed"),
    ("alchemy", "AlchemyTable"),
    ("any_wood", "AnyWood"),
    ("any_iron_bar", "AnyIronBar"),
    ("any_pressure_plate", "AnyPressurePlate"),
    ("any_sand", "AnySand"),
    ("any_fragment", "AnyFragment"),
    ("crimson", "CrimsonWorld"),
    ("corruption", "CorruptionWorld"),
    ("not_decraftable", "NotDecraftable"),
)

# The two edge types.
DIRECT_EDGE = "item_transform"
DECOMPOSE_EDGE = "deconstruct"


def struct(**fields: DataType) -> StructType:
    out = StructType()
    for name, dtype in fields.items():
        out.add(name, dtype)
    return out


_SLOT = struct(type=INT, name=TEXT, stack=INT)

ITEMS = struct(id=INT, name=TEXT, internal_name=TEXT, value=INT, sell_price=INT)
# ``part`` numbers the rows of one recipe or shop whose list is too long for one row; most have part 0 only.
RECIPES = struct(
    recipe_index=INT,
    part=LONG,
    result_item_id=INT,
    result_item_name=TEXT,
    result_amount=INT,
    ingredients=ArrayType(struct(item_id=INT, name=TEXT, count=INT)),
    crafting_stations=ArrayType(TEXT),
    conditions=ArrayType(TEXT),
)
EDGES = struct(
    input_item_id=INT,
    input_item_name=TEXT,
    output_item_id=INT,
    output_item_name=TEXT,
    output_amount=INT,
    type=TEXT,
)
SHOPS = struct(
    npc_id=INT,
    npc_name=TEXT,
    shop_name=TEXT,
    part=LONG,
    items=ArrayType(struct(item_id=INT, name=TEXT, buy_price=INT, conditions=ArrayType(TEXT))),
)
MANIFEST = struct(
    id=INT, category=TEXT, internal_name=TEXT, sprite_file=TEXT, width=INT, height=INT
)

RAW_ITEMS = struct(id=INT, value=INT, display_name=TEXT)
INTERNAL_NAMES = struct(id=INT, internal_name=TEXT)
RAW_RECIPES = struct(
    recipe_index=INT,
    result=_SLOT,
    required_items=ArrayType(_SLOT),
    required_tiles=ArrayType(INT),
    **{flag: BOOL for flag, _ in RECIPE_FLAGS},
    custom_results=ArrayType(_SLOT),
)
TILE_NAMES = struct(tile_id=INT, name=TEXT)
RUN_LOG = struct(
    run_id=TEXT,
    phase_name=TEXT,
    phase_key=TEXT,
    row_count=LONG,
    succeeded=BOOL,
    json_path=TEXT,
    csv_path=TEXT,
    elapsed_ms=LONG,
    errors=ArrayType(TEXT),
)

# Public JSON field names of each dataset, in CSV column order.
JSON_FIELDS: dict[str, tuple[tuple[str, str], ...]] = {
    "items": (
        ("id", "Id"),
        ("name", "Name"),
        ("internal_name", "InternalName"),
        ("value", "Value"),
        ("sell_price", "SellPrice"),
    ),
    "recipes": (
        ("recipe_index", "RecipeIndex"),
        ("part", "Part"),
        ("result_item_id", "ResultItemId"),
        ("result_item_name", "ResultItemName"),
        ("result_amount", "ResultAmount"),
        ("ingredients", "Ingredients"),
        ("crafting_stations", "CraftingStations"),
        ("conditions", "Conditions"),
    ),
    "shimmer": (
        ("input_item_id", "InputItemId"),
        ("input_item_name", "InputItemName"),
        ("output_item_id", "OutputItemId"),
        ("output_item_name", "OutputItemName"),
        ("output_amount", "OutputAmount"),
        ("type", "Type"),
    ),
    "npc_shops": (
        ("npc_id", "NpcId"),
        ("npc_name", "NpcName"),
        ("shop_name", "ShopName"),
        ("part", "Part"),
        ("items", "Items"),
    ),
    "sprite_manifest": (
        ("id", "id"),
        ("category", "category"),
        ("internal_name", "internalName"),
        ("sprite_file", "spriteFile"),
        ("width", "width"),
        ("height", "height"),
    ),
}
# The manifest's CSV header differs from its JSON names.
MANIFEST_CSV_FIELDS = ("Id", "Category", "InternalName", "SpriteFile", "Width", "Height")
# Field names inside nested lists.
NESTED_JSON_FIELDS = {
    "ingredients": (("item_id", "ItemId"), ("name", "Name"), ("count", "Count")),
    "items": (
        ("item_id", "ItemId"),
        ("name", "Name"),
        ("buy_price", "BuyPrice"),
        ("conditions", "Conditions"),
    ),
}
