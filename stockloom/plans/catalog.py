"""The five catalog datasets and the runner that writes them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stockloom.functions import (
    category_rank,
    display_name,
    fallback_label,
    flags_to_labels,
    nullif_blank,
    resolve_name,
    sell_price,
    take_while,
)
from stockloom.functions.names import RECIPE_ITEM_LABEL, STATION_LABEL
from stockloom.operators.edges import EDGE_ORDER
from stockloom.operators.lookups import lookup_left
from stockloom.operators.scans import materialize
from stockloom.schemas import JSON_FIELDS, MANIFEST_CSV_FIELDS, RECIPE_FLAGS, RUN_LOG
from stockloom.sinks import (
    append_run_log,
    public_names,
    write_csv_flat,
    write_json,
    write_placeholder,
)
from stockloom.sources.tables import delete_path, path_exists

# Phases in running order with the stem of their output files.
PHASE_STEMS: tuple[tuple[str, str], ...] = (
    ("items", "items"),
    ("shimmer", "shimmer"),
    ("recipes", "recipes"),
    ("npc_shops", "npc_shops"),
    ("sprites", "sprite_manifest"),
)


def item_catalog(raw_items: DataFrame, internal_names: DataFrame) -> DataFrame:
    """Items with positive ids: display name, internal name, value and sell price."""
    named = lookup_left(
        raw_items.filter(F.col("id") >= 1), internal_names, "id", {"internal_name": "_internal"}
    )
    return named.select(
        "id",
        display_name(F.col("display_name"), F.col("_internal")).alias("name"),
        F.coalesce("_internal", F.lit("")).alias("internal_name"),
        "value",
        sell_price(F.col("value")).alias("sell_price"),
    )


def _station_names(recipes: DataFrame, tiles: str, tile_names: DataFrame) -> DataFrame:
    """(tiles, crafting_stations) for every distinct tile list.

    Few tile lists are distinct, so names are resolved per list and not per recipe. The result is stored:
    Spark sees its size, and recipes with their lists need not move to meet it.
    """
    lists = recipes.select(tiles).filter(F.size(tiles) > 0).distinct()
    exploded = lists.select(tiles, F.posexplode(tiles).alias("pos", "tile_id"))
    named = lookup_left(exploded, tile_names, "tile_id", {"name": "_name"})
    name = resolve_name(F.col("_name"), label=STATION_LABEL, id_col=F.col("tile_id"))
    entries = F.array_sort(F.collect_list(F.struct("pos", name.alias("name"))))
    return materialize(
        named.groupBy(tiles).agg(F.transform(entries, lambda x: x["name"]).alias("crafting_stations"))
    )


def recipe_catalog(
    raw_recipes: DataFrame,
    tile_names: DataFrame,
    extra: Sequence[str] = (),
    tile_lists: DataFrame | None = None,
) -> DataFrame:
    """Recipes with their ingredients, stations and conditions; row-local but for station names.

    Ingredients stop at the first id <= 0, stations at the first id < 0 (a null tile is tile 0). A
    recipe without a result has id 0, no name and amount 0. ``extra`` columns are kept. The distinct
    tile lists are read from ``tile_lists`` (a cheaper frame with ``required_tiles``) when given.
    """

    def item_name(x: Column) -> Column:
        return F.coalesce(nullif_blank(x["name"]), fallback_label(RECIPE_ITEM_LABEL, x["type"]))

    result = F.col("result")
    ingredients = F.transform(
        take_while(F.col("required_items"), lambda x: x["type"] <= 0),
        lambda x: F.struct(
            x["type"].alias("item_id"), item_name(x).alias("name"), x["stack"].alias("count")
        ),
    )
    tiles = F.transform(
        take_while(
            F.col("required_tiles"), lambda x: F.coalesce(x, F.lit(0)) < 0, skip_null=False
        ),
        lambda x: F.coalesce(x, F.lit(0)),
    )
    flags = [(F.coalesce(F.col(flag), F.lit(False)), label) for flag, label in RECIPE_FLAGS]
    shaped = raw_recipes.select(
        "recipe_index",
        *extra,
        F.coalesce(result["type"], F.lit(0)).alias("result_item_id"),
        F.when(result.isNotNull(), item_name(result)).alias("result_item_name"),
        F.coalesce(result["stack"], F.lit(0)).alias("result_amount"),
        ingredients.alias("ingredients"),
        tiles.alias("_tiles"),
        flags_to_labels(flags).alias("conditions"),
    )
    lists = (raw_recipes if tile_lists is None else tile_lists).select(tiles.alias("_tiles"))
    joined = shaped.join(_station_names(lists, "_tiles", tile_names), "_tiles", "left")
    return joined.select(
        "recipe_index",
        *extra,
        "result_item_id",
        "result_item_name",
        "result_amount",
        "ingredients",
        F.coalesce("crafting_stations", F.array().cast("array<string>")).alias("crafting_stations"),
        "conditions",
    )


# --- running phases ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phase:
    """One phase: its key, the stem of its files, the dataset's name and how to build it."""

    key: str
    stem: str
    build: Callable[[SparkSession], DataFrame]


def catalog_phases(builders: dict[str, Callable[[SparkSession], DataFrame]]) -> list[Phase]:
    """Phases in their fixed order; a builder per key."""
    unknown = set(builders) - {key for key, _ in PHASE_STEMS}
    if unknown:
        raise ValueError(f"unknown phases: {sorted(unknown)}")
    return [Phase(key, stem, builders[key]) for key, stem in PHASE_STEMS if key in builders]


def table_path(folder: str, stem: str) -> str:
    return f"{folder.rstrip('/')}/{stem}.parquet"


def dataset_order(df: DataFrame, stem: str) -> DataFrame:
    """Rows of a dataset in their contract order: a range-partitioned sort."""
    if stem == "sprite_manifest":
        return df.orderBy(category_rank(F.col("category")), "id", "sprite_file")
    orders = {
        "items": ["id"],
        "shimmer": EDGE_ORDER,
        "recipes": ["recipe_index", "part"],
        "npc_shops": [*(["shop_id"] if "shop_id" in df.columns else ["npc_id", "shop_name"]), "part"],
    }
    return df.orderBy(*[c for c in orders[stem] if c in df.columns])


def run_phase(
    spark: SparkSession,
    phase: Phase,
    folder: str,
    ordered: bool = True,
    run_id: str = "",
) -> dict[str, object]:
    """Build and write one dataset; returns its run-log row and never raises for a failed phase.

    The plan runs once, into a Parquet table; JSON and CSV are written from that table, each sorted unless
    ``ordered`` is off, as Spark does not read files in the order of their names. The row count comes with
    the write. No rows is a failure. A failed phase replaces its outputs, also those of an earlier run, by
    placeholders.
    """
    started = time.monotonic()
    root = folder.rstrip("/")
    json_path, csv_path = f"{root}/{phase.stem}.json", f"{root}/{phase.stem}.csv"
    errors: list[str] = []
    count = 0
    try:
        seen = Observation(f"rows of {phase.key}")
        built = phase.build(spark).observe(seen, F.count(F.lit(1)).alias("n"))
        built.write.mode("overwrite").parquet(table_path(root, phase.stem))
        count = seen.get["n"]
        if count == 0:
            errors.append("extracted 0 rows")
    except Exception as error:  # a phase may fail in any way; the others still run
        errors.append(f"extract failed: {error}")
    else:
        try:
            table = spark.read.parquet(table_path(root, phase.stem))
            table = dataset_order(table, phase.stem) if ordered else table
            delete_path(spark, json_path)
            delete_path(spark, csv_path)
            write_json(public_names(table, phase.stem), json_path)
            whole = table if "part" in table.columns else table.withColumn("part", F.lit(0))
            columns = [name for name, _ in JSON_FIELDS[phase.stem]]
            header = [alias for _, alias in JSON_FIELDS[phase.stem]]
            if phase.stem == "sprite_manifest":
                header = list(MANIFEST_CSV_FIELDS)
            write_csv_flat(whole.select(*columns), csv_path, header)
        except Exception as error:
            errors.append(f"write failed: {error}")
    errors += [f"missing output: {p}" for p in (json_path, csv_path) if not path_exists(spark, p)]
    if errors:
        write_placeholder(spark, json_path, csv_path, table_path(root, phase.stem))
    return {
        "run_id": run_id,
        "phase_name": phase.key.replace("_", "-"),
        "phase_key": phase.key,
        "row_count": count,
        "succeeded": not errors,
        "json_path": json_path,
        "csv_path": csv_path,
        "elapsed_ms": int((time.monotonic() - started) * 1000),
        "errors": errors,
    }


def run_catalog(
    spark: SparkSession, phases: Sequence[Phase], folder: str, run_id: str | None = None
) -> bool:
    """Run all phases in order, append their outcomes to the run log; True when all succeeded.

    ``run_id`` tells the runs in one log apart; by default it is made up.
    """
    run_id = run_id or uuid.uuid4().hex
    outcomes = [run_phase(spark, phase, folder, run_id=run_id) for phase in phases]
    rows = [tuple(o[name] for name in RUN_LOG.fieldNames()) for o in outcomes]
    append_run_log(spark.createDataFrame(rows, RUN_LOG), f"{folder.rstrip('/')}/run_log")
    return all(o["succeeded"] for o in outcomes)
