"""Texture assets: every part becomes one binary file, and its header is read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.operators.assets import (
    asset_header,
    asset_manifest,
    described_assets,
    manifest_order,
)
from stockloom.operators.checks import missing_files, progress_counters
from stockloom.queries.catalog import SQL_INTERNAL, internal_name
from stockloom.operators.scans import materialize, with_position
from stockloom.queries.registry import query, table
from stockloom.sources.files import assets_of

READER = "Microsoft.Xna.Framework.Content.Texture2DReader"


def _le32(value: Column) -> Column:
    """Little-endian bytes of a non-negative 32-bit integer."""
    digits = F.lpad(F.hex(value.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, start, 2) for start in (7, 5, 3, 1)]))


def asset_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) as a binary-file scan would give them, with damage by type and brand."""
    kind, brand, size = F.col("p_type"), F.col("p_brand"), F.col("p_size")
    height = F.floor(size / 10)
    pixels = F.unhex(F.repeat(F.lit("00"), (size * height * 4).cast("int")))
    reader = F.when(kind == "PROMO", "Sound.SongReader").otherwise(READER)
    payload = F.concat(
        F.lit(b"\x01"),
        F.unhex(F.lpad(F.hex(F.length(reader)), 2, "0")),
        reader.cast("binary"),
        _le32(F.lit(0)),
        F.lit(b"\x00\x01"),
        _le32(F.lit(0)),
        _le32(size),
        _le32(height),
        _le32(F.lit(1)),
        _le32(F.length(pixels)),
        pixels,
    )
    cut = F.when(brand == "Brand#3", F.substring(payload, F.lit(1), F.length(payload) - 5)).otherwise(
        payload
    )
    flags = F.when(brand == "Brand#1", F.lit(b"\x80")).when(brand == "Brand#2", F.lit(b"\xc0")).otherwise(
        F.lit(b"\x00")
    )
    content = F.concat(
        F.when(kind == "SMALL", F.lit(b"XNA")).otherwise(F.lit(b"XNB")),
        F.lit(b"w"),
        F.when(kind == "LARGE", F.lit(b"\x03")).otherwise(F.lit(b"\x05")),
        flags,
        _le32(F.length(cut) + 10),
        cut,
    )
    prefix = (
        F.when(kind == "ECONOMY", "item_")
        .when(kind == "MEDIUM", "NPC_")
        .when(brand == "Brand#9", "Tile_")
        .otherwise("Item_")
    )
    extension = F.when(brand == "Brand#8", ".XNB").otherwise(".xnb")
    return table(spark, folder, "part").select(
        F.concat(F.lit("content/Images/"), prefix, F.col("p_partkey").cast("string"), extension).alias("path"),
        content.alias("content"),
    )


SQL_ASSETS = f"""
    a AS (
      SELECT p_partkey, p_size AS w, p_size // 10 AS h, {SQL_INTERNAL} AS iname,
        CASE WHEN p_type = 'ECONOMY' THEN 'item_' WHEN p_type = 'MEDIUM' THEN 'NPC_' WHEN p_brand = 'Brand#9' THEN 'Tile_'
          ELSE 'Item_' END || p_partkey AS stem,
        CASE WHEN p_brand = 'Brand#8' THEN '.XNB' ELSE '.xnb' END AS ext,
        CASE WHEN p_type = 'SMALL' THEN 'invalid magic' WHEN p_type = 'LARGE' THEN 'unsupported version'
          WHEN p_brand = 'Brand#2' THEN 'lz4 compressed' WHEN p_brand = 'Brand#1' THEN 'compressed'
          WHEN p_type = 'PROMO' THEN 'not a texture'
          WHEN p_brand = 'Brand#3' AND p_size < 10 THEN 'truncated'
          WHEN p_size < 10 THEN 'invalid dimensions' WHEN p_brand = 'Brand#3' THEN 'truncated' END AS error,
        p_brand IN ('Brand#1', 'Brand#2') AS compressed
      FROM part),
    named AS (
      SELECT CAST(p_partkey AS INT) AS id, CASE WHEN starts_with(stem, 'NPC_') THEN 'npc' ELSE 'item' END AS category,
        CASE WHEN starts_with(stem, 'NPC_') THEN 'NPC_' || p_partkey
          WHEN trim(coalesce(iname, '')) = '' THEN 'Item_' || p_partkey ELSE iname END AS internal_name,
        'sprites/' || CASE WHEN starts_with(stem, 'NPC_') THEN 'npcs/' ELSE 'items/' END || stem || '.png' AS sprite_file,
        w AS width, h AS height, error
      FROM a WHERE NOT starts_with(stem, 'Tile_'))"""


@query(
    "asset_header",
    f"""WITH {SQL_ASSETS}
    SELECT 'content/Images/' || stem || ext AS path, CASE WHEN error IS NULL THEN 0 END AS surface_format,
      CASE WHEN error IS NULL THEN w END AS width, CASE WHEN error IS NULL THEN CAST(h AS INT) END AS height,
      compressed, error
    FROM a""",
)
def _asset_header(spark: SparkSession, folder: str) -> DataFrame:
    return asset_header(asset_files(spark, folder))


def item_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("id"), internal_name().alias("internal_name")
    )


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return asset_manifest(assets_of(asset_files(spark, folder)), item_names(spark, folder))


@query(
    "asset_manifest",
    f"""WITH {SQL_ASSETS}
    SELECT id, category, internal_name, sprite_file, width, CAST(height AS INT) AS height,
      CASE WHEN category = 'item' THEN 0 ELSE 1 END AS category_rank
    FROM named WHERE error IS NULL""",
)
def _asset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(spark, folder)


@query(
    "manifest_order",
    f"""WITH {SQL_ASSETS}
    SELECT id, category, sprite_file, row_number() OVER (ORDER BY category <> 'item', id, sprite_file) - 1 AS position
    FROM named WHERE error IS NULL""",
)
def _manifest_order(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the manifest with their place; the sort reads a stored table, so headers are parsed once."""
    stored = materialize(manifest(spark, folder).select("id", "category", "sprite_file", "category_rank"))
    return with_position(manifest_order(stored)).drop("category_rank")


@query(
    "asset_progress",
    f"""WITH {SQL_ASSETS}
    SELECT count(*) AS processed, CAST(count_if(error IS NULL) AS BIGINT) AS saved, CAST(count_if(error IS NOT NULL) AS BIGINT) AS failed FROM named""",
)
def _asset_progress(spark: SparkSession, folder: str) -> DataFrame:
    return progress_counters(
        described_assets(assets_of(asset_files(spark, folder)), item_names(spark, folder))
    )


@query(
    "missing_files",
    f"""WITH {SQL_ASSETS}
    SELECT id, sprite_file FROM named WHERE error IS NULL
      AND sprite_file NOT IN (SELECT 'sprites/items/Item_' || p_partkey || '.png' FROM part WHERE p_size <= 45)""",
)
def _missing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows without a picture, when only the smaller parts have one."""
    pictures = table(spark, folder, "part").filter("p_size <= 45").select(
        F.concat(F.lit("sprites/items/Item_"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path")
    )
    return missing_files(manifest(spark, folder), F.col("sprite_file"), pictures).select(
        "id", "sprite_file"
    )
