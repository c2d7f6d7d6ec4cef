"""The catalog's validation suite: five sections, one report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockloom.functions import contains_all, is_blank, normalize_category, normalize_path
from stockloom.functions.text import SEPARATORS, strip_whitespace
from stockloom.operators.checks import (
    RangeCheck,
    Rule,
    count_metrics,
    count_range,
    dangling_ids,
    fk_violations,
    fk_violations_nested,
    missing_files,
    row_rules,
    spot_check,
    union_failures,
)
from stockloom.operators.dedupe import first_match
from stockloom.operators.scans import materialize
from stockloom.schemas import (
    DECOMPOSE_EDGE,
    DIRECT_EDGE,
    EDGES,
    ITEMS,
    JSON_FIELDS,
    MANIFEST,
    NESTED_JSON_FIELDS,
    RECIPES,
    SHOPS,
)
from stockloom.sources.arrays import as_typed, read_json_array
from stockloom.sources.files import existing, list_files
from stockloom.sources.lines import read_lines

# The datasets, the files a complete run leaves, and the expected counts.
DATASETS: tuple[tuple[str, StructType], ...] = (
    ("items", ITEMS),
    ("recipes", RECIPES),
    ("shimmer", EDGES),
    ("npc_shops", SHOPS),
    ("sprite_manifest", MANIFEST),
)
REQUIRED_FILES: tuple[str, ...] = (
    "items.json",
    "items.csv",
    "recipes.json",
    "recipes.csv",
    "shimmer.json",
    "shimmer.csv",
    "npc_shops.json",
    "npc_shops.csv",
    "sprite_manifest.json",
    "sprite_manifest.csv",
)
DEFAULT_RANGES: tuple[RangeCheck, ...] = (
    RangeCheck("items_range", 5300, 5600),
    RangeCheck("recipes_range", 2800, 3100),
    RangeCheck("shimmer_item_transform_range", 200, 350),
    RangeCheck("shimmer_deconstruct_range", 3800, 4600),
    RangeCheck("npc_shops_min", 25),
    RangeCheck("sprite_manifest_range", 5500, 7000),
    RangeCheck("sprite_items_min", 5000),
    RangeCheck("sprite_npcs_min", 600),
)
# The three known facts.
SPOT_RECIPE = (8, (9, 23))
SPOT_OFFER = (17, 8)
SPOT_EDGE = (8, 5353, DIRECT_EDGE)


def load_dataset(
    spark: SparkSession, folder: str, stem: str, schema: StructType
) -> tuple[DataFrame, str | None]:
    """(records with pos and is_object, load error) of ``<stem>.json``.

    A single file is one JSON array; a folder is JSON lines, which scales. In JSON lines the position is
    the number of lines before a record, in all files by name and in its own. A line that is no JSON is a
    load error, and no record. The typed records are stored, so that all checks share one parse.
    """
    path = f"{folder.rstrip('/')}/{stem}.json"
    names = {"": dict(JSON_FIELDS[stem])}
    names |= {column: dict(fields) for column, fields in NESTED_JSON_FIELDS.items()}
    if not _is_folder(spark, path):
        records, error = read_json_array(spark, path)
    else:
        parsed = _numbered(read_lines(spark, path)).select("pos", "line", F.try_parse_json("line").alias("record"))
        # The first sign of a JSON text tells an object; its whole schema would be made for every line.
        is_object = F.col("record").isNotNull() & F.ltrim("line", F.lit(" \t\r\n")).startswith("{")
        typed = as_typed(parsed.select("pos", is_object.alias("is_object"), "record"), schema, names, keep_record=True)
        typed = typed.withColumn("_is_json", F.col("record").isNotNull())
        # Only the rules of the manifest show raw values.
        typed = materialize(typed if stem == "sprite_manifest" else typed.drop("record"))
        bad = typed.filter("NOT _is_json").count()
        error = f"invalid json in {stem}.json: {bad} lines" if bad else None
        return typed.filter("_is_json").drop("_is_json"), error
    return materialize(as_typed(records, schema, names, keep_record=True)), error


def _numbered(lines: DataFrame) -> DataFrame:
    """(pos, line): positions over all files in the order of their names; one row per file is counted."""
    counts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))
    return lines.join(starts, "file").select((F.col("start") + F.col("line_no") - 1).alias("pos"), "line")


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def required_file_failures(
    spark: SparkSession, folder: str, load_errors: dict[str, str | None]
) -> tuple[DataFrame, DataFrame]:
    """(file, exists) of every required file, and (file, error) of what is missing or unreadable.

    A missing JSON file gives two failures: it is missing, and it could not be loaded.
    """
    required = existing(spark, folder, REQUIRED_FILES)
    failures = [(r["file"], "missing") for r in required.collect() if not r["exists"]]
    failures += [(e.split(":", 1)[0], e) for e in load_errors.values() if e is not None]
    return required, spark.createDataFrame(failures, "file string, error string")


def _first_part() -> Column:
    """True once for each recipe or shop: its further parts are not counted."""
    return F.coalesce(F.col("part"), F.lit(0)) == 0


def catalog_counts(data: dict[str, DataFrame]) -> DataFrame:
    """(metric, actual) for every range check; one scan per dataset."""
    kind = strip_whitespace(F.coalesce(F.col("type"), F.lit("")), SEPARATORS)
    category = normalize_category(F.col("category"))
    return (
        count_metrics(data["items"], {"items_range": None})
        .unionByName(count_metrics(data["recipes"], {"recipes_range": _first_part()}))
        .unionByName(
            count_metrics(
                data["shimmer"],
                {
                    "shimmer_total": None,
                    "shimmer_item_transform_range": kind == DIRECT_EDGE,
                    "shimmer_deconstruct_range": kind == DECOMPOSE_EDGE,
                },
            )
        )
        .unionByName(count_metrics(data["npc_shops"], {"npc_shops_min": _first_part()}))
        .unionByName(
            count_metrics(
                data["sprite_manifest"],
                {
                    "sprite_manifest_range": None,
                    "sprite_items_min": category == "item",
                    "sprite_npcs_min": category == "npc",
                },
            )
        )
    )


def foreign_key_failures(data: dict[str, DataFrame]) -> DataFrame:
    """Every reference to an item that does not exist, over all datasets."""
    items = data["items"].select("id").filter(F.col("id").isNotNull()).distinct()
    recipe_id = F.coalesce(F.col("recipe_index"), F.col("pos"))
    edge_id = F.to_json(
        F.struct(
            F.col("pos").alias("index"),
            F.col("input_item_id").alias("input"),
            F.col("output_item_id").alias("output"),
            "type",
        ),
        {"ignoreNullFields": "false"},
    )
    shop_id = F.to_json(
        F.struct(
            F.col("pos").alias("index"), F.col("npc_id").alias("npcId"), F.col("shop_name").alias("shopName")
        ),
        {"ignoreNullFields": "false"},
    )
    manifest = data["sprite_manifest"]
    other = (normalize_category(F.col("category")) != "item") | F.coalesce(
        F.col("id") <= 0, F.lit(True)
    )
    # All references have one parent, so what dangles is found once, from ids alone.
    dangling = dangling_ids(
        [
            (data["recipes"], F.array("result_item_id")),
            (data["recipes"], F.transform("ingredients", lambda x: x["item_id"])),
            (data["shimmer"], F.array("input_item_id", "output_item_id")),
            (data["npc_shops"], F.transform("items", lambda x: x["item_id"])),
            (manifest.filter(~F.coalesce(other, F.lit(False))), F.array("id")),
        ],
        items,
        "id",
    )
    return union_failures(
        fk_violations(
            data["recipes"], F.col("result_item_id"), items, "id", "recipes", "ResultItemId", recipe_id, dangling=dangling
        ),
        fk_violations_nested(
            data["recipes"], "ingredients", "item_id", items, "id", "recipes", "Ingredients[].ItemId", recipe_id, dangling
        ),
        fk_violations(
            data["shimmer"], F.col("input_item_id"), items, "id", "shimmer", "InputItemId", edge_id, dangling=dangling
        ),
        fk_violations(
            data["shimmer"], F.col("output_item_id"), items, "id", "shimmer", "OutputItemId", edge_id, dangling=dangling
        ),
        fk_violations_nested(
            data["npc_shops"], "items", "item_id", items, "id", "npc_shops", "Items[].ItemId", shop_id, dangling
        ),
        fk_violations(
            manifest, F.col("id"), items, "id", "sprite_manifest", "id", F.col("pos"), exempt=other, dangling=dangling
        ),
    )


def manifest_rules(raw: bool = False) -> list[Rule]:
    """Rules of one manifest row. A blank path skips the prefix rule, as does an unknown category.

    The messages are fixed values. With ``raw`` a value of the wrong type is shown as it stands in ``record``.
    """

    def held(name: str) -> Column:
        alias = dict(JSON_FIELDS["sprite_manifest"])[name]
        given = F.to_json(F.try_variant_get("record", f"$.{alias}", "variant")) if raw else F.lit(None)
        return F.coalesce(F.col(name).cast("string"), given.cast("string"))

    category = normalize_category(F.col("category"))
    path = F.col("sprite_file")
    blank = is_blank(path)
    known = category.isin("item", "npc")
    prefix = F.concat(F.lit("sprites/"), category, F.lit("s/"))

    def not_positive(name: str, low: int) -> Column:
        return F.col(name).isNull() | (F.col(name) < low)

    wrong_place = F.concat(
        F.lit("spriteFile must start with '"), prefix, F.lit("' for category '"), category, F.lit("'")
    )
    return [
        Rule("id", "id must be a non-negative integer", not_positive("id", 0), held("id")),
        Rule("category", "category must be 'item' or 'npc'", ~known, held("category")),
        Rule("width", "width must be a positive integer", not_positive("width", 1), held("width")),
        Rule("height", "height must be a positive integer", not_positive("height", 1), held("height")),
        Rule("spriteFile", "spriteFile must be a non-empty string", blank, held("sprite_file")),
        Rule(
            "spriteFile",
            wrong_place,
            ~blank & known & ~normalize_path(path).startswith(prefix),
            path,
        ),
    ]


def manifest_failures(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Broken row rules, and rows whose picture is not in the listing."""
    broken = row_rules(manifest, F.col("pos"), manifest_rules(raw="record" in manifest.columns))
    named = manifest.filter(~is_blank(F.col("sprite_file")))
    clean = F.regexp_replace(normalize_path(F.col("sprite_file")), "/+", "/")
    absent = missing_files(named, clean, listing).select(
        F.col("pos").alias("record_id"),
        F.lit("spriteFile").alias("field"),
        F.lit("referenced sprite PNG is missing").alias("error"),
        F.col("sprite_file").alias("value"),
    )
    return broken.unionByName(absent)


def catalog_spot_checks(data: dict[str, DataFrame]) -> DataFrame:
    """Three known facts with the first record that shows each."""
    result, required = SPOT_RECIPE
    ingredient_ids = F.array_sort(F.array_distinct(F.array_compact(F.transform("ingredients", lambda x: x["item_id"]))))
    # A recipe may stand in several parts; a recipe without an index is its own row.
    wanted = F.array(*[F.lit(r) for r in required])
    owner = F.struct("recipe_index", F.when(F.col("recipe_index").isNull(), F.col("pos")).alias("own"))
    whole = (
        data["recipes"]
        .filter(F.col("result_item_id") == result)
        .groupBy(owner.alias("owner"))
        .agg(
            F.min("pos").alias("pos"),
            F.min_by(ingredient_ids, "pos").alias("ids"),
            F.array_distinct(F.flatten(F.collect_set(F.array_intersect(ingredient_ids, wanted)))).alias("hits"),
        )
    )
    recipe = first_match(whole, contains_all(F.col("hits"), required), ["pos"]).select(
        F.col("owner.recipe_index").alias("RecipeIndex"),
        F.lit(result).alias("ResultItemId"),
        F.col("ids").alias("IngredientItemIds"),
    )
    npc, item = SPOT_OFFER
    offered = F.filter("items", lambda x: x["item_id"] == item)
    offer = first_match(
        data["npc_shops"], (F.col("npc_id") == npc) & (F.size(offered) > 0), ["pos"]
    ).select(
        F.col("npc_id").alias("NpcId"),
        F.col("shop_name").alias("ShopName"),
        F.lit(item).alias("ItemId"),
        offered[0]["buy_price"].alias("BuyPrice"),
    )
    source, target, kind = SPOT_EDGE
    edge = first_match(
        data["shimmer"],
        (F.col("input_item_id") == source) & (F.col("output_item_id") == target) & (F.col("type") == kind),
        ["pos"],
    ).select(
        F.col("input_item_id").alias("InputItemId"),
        F.col("output_item_id").alias("OutputItemId"),
        F.col("type").alias("Type"),
    )
    return (
        spot_check("torch_recipe_exists", recipe, f"result {result} with ingredients {list(required)}")
        .unionByName(spot_check("merchant_sells_torch", offer, f"npc {npc} sells item {item}"))
        .unionByName(spot_check("known_shimmer_transform", edge, f"{source} -> {target} ({kind})"))
    )


@dataclass
class Validation:
    """All results as DataFrames; nothing has been computed on the driver but load errors."""

    required: DataFrame
    required_failures: DataFrame
    counts: DataFrame
    ranges: DataFrame
    foreign_keys: DataFrame
    manifest: DataFrame
    spots: DataFrame
    item_ids: DataFrame


def validate_catalog(
    spark: SparkSession, folder: str, ranges: tuple[RangeCheck, ...] = DEFAULT_RANGES
) -> Validation:
    """Check the five datasets in ``folder``."""
    data: dict[str, DataFrame] = {}
    errors: dict[str, str | None] = {}
    for stem, schema in DATASETS:
        data[stem], errors[stem] = load_dataset(spark, folder, stem, schema)
    required, required_failures = required_file_failures(spark, folder, errors)
    counts = catalog_counts(data)
    root = folder.rstrip("/")
    listing = list_files(spark, f"{root}/sprites", "*.png", recursive=True).select(
        F.concat(F.lit("sprites/"), "path").alias("path")
    )
    return Validation(
        required=required,
        required_failures=required_failures,
        counts=counts,
        ranges=count_range(counts, ranges),
        foreign_keys=foreign_key_failures(data),
        manifest=manifest_failures(data["sprite_manifest"], listing),
        spots=catalog_spot_checks(data),
        item_ids=data["items"].agg(F.count_distinct("id").alias("n_ids")),
    )
