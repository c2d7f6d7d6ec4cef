"""Sources and sinks: each query writes what it derives from the tables to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.operators.checks import RangeCheck
from stockloom.operators.scans import shared_folder
from stockloom.plans.catalog import Phase, catalog_phases, run_catalog, run_phase
from stockloom.plans.report import build_report, phase_summary, phase_totals
from stockloom.plans.validation import validate_catalog
from stockloom.queries.registry import query, table
from stockloom.schemas import ITEMS, MANIFEST, RECIPES, SHOPS
from stockloom.sinks import public_names, read_run_log, write_csv_flat, write_json, write_named_files, write_text_file
from stockloom.sources import as_typed, list_assets, path_exists, read_json_array, read_lines, read_table


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


#: Order keys of one array file: the files are bounded, their number grows with the table.
ARRAY_KEYS = 1 << 18


@query(
    "json_array_records",
    """
    SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey % 5 <> 0 AS is_object,
      CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_orderkey AS INT) END AS id,
      CASE WHEN l_partkey % 5 > 1 THEN 'a, "[' || chr(92) || l_suppkey || '{' END AS name,
      CASE WHEN l_partkey % 5 = 0 THEN '{"_raw":"],' || l_suppkey || '{"}' END AS raw FROM lineitem
    """,
)
def _json_array_records(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays of all line items; some elements are no objects, some names are no text, and texts hold brackets, commas and quotes."""
    items = table(spark, folder, "lineitem")
    kind = F.col("l_partkey") % 5
    key, supplier = F.col("l_orderkey"), F.col("l_suppkey").cast("string")
    name = F.concat(F.lit('a, "[\\'), supplier, F.lit("{"))
    lists = F.array(F.array(key, F.col("l_partkey")), F.array(F.col("l_linenumber")))
    element = (
        F.when(kind == 0, F.concat(F.lit('"],'), supplier, F.lit('{"')))
        .when(kind == 1, F.to_json(F.struct(key.alias("Id"), key.alias("Name"), lists.alias("Lists"))))
        .otherwise(F.to_json(F.struct(lists.alias("Lists"), key.alias("Id"), name.alias("Name"))))
    )
    file = F.format_string("%012d", F.expr(f"l_orderkey div {ARRAY_KEYS}"))
    inside = Window.partitionBy("file").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    before = F.when(F.row_number().over(inside) == 1, "[").otherwise(",")
    after = F.when(F.lead(F.lit(1)).over(inside).isNull(), "]").otherwise("")
    path = fresh_folder(spark)
    items.withColumns({"file": file, "element": element}).select("file", F.concat(before, "element", after)).write.partitionBy("file").text(path)
    records, error = read_json_array(spark, path)
    if error is not None:
        raise ValueError(error)
    typed = as_typed(records, ITEMS, {"": {"id": "Id", "name": "Name"}}, keep_record=True)
    return typed.select("pos", "is_object", "id", "name", F.when(~F.col("is_object"), F.to_json("record")).alias("raw"))


@query(
    "list_assets",
    """
    SELECT CAST(p_partkey AS INT) AS id, CASE p_partkey % 3 WHEN 0 THEN 'npc' ELSE 'item' END AS category,
      CASE p_partkey % 3 WHEN 0 THEN 'sprites/npcs/NPC_' ELSE 'sprites/items/item_' END || p_partkey || '.png' AS sprite_file,
      p_partkey % 4 AS length
    FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 10 <> 0
    """,
)
def _list_assets(spark: SparkSession, folder: str) -> DataFrame:
    """A file for each part, some of them empty, of other names or in a subfolder, and the assets found among them."""
    key = F.col("p_partkey")
    number = key.cast("string")
    name = (
        F.when(key % 3 == 0, F.concat(F.lit("NPC_"), number, F.lit(".xnb")))
        .when(key % 3 == 1, F.concat(F.lit("item_"), number, F.lit(".XNB")))
        .otherwise(F.concat(F.lit("Item_x"), number, F.lit(".xnb")))
    )
    below = F.when(key % 10 == 0, "deep/").otherwise("")
    content = F.repeat(F.lit("x"), (key % 4).cast("int")).cast("binary")
    path = fresh_folder(spark)
    write_named_files(table(spark, folder, "part").select(F.concat(below, name).alias("name"), content.alias("content")), path)
    return list_assets(spark, path).select("id", "category", "sprite_file", "length")


@query(
    "lines_numbered",
    """
    SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, true AS in_order FROM documents
    """,
)
def _lines_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text files: the lines of each keep their distance from its first line."""
    documents = table(spark, folder, "documents")
    tagged = F.transform(
        F.split("text", "\n"), lambda line, k: F.concat_ws("|", F.col("doc_id").cast("string"), k.cast("string"), line)
    )
    path = fresh_folder(spark)
    documents.select(F.array_join(tagged, "\n")).write.text(path)
    parts = F.split("line", "[|]", 3)
    lines = read_lines(spark, path).select(
        "file", parts[0].cast("bigint").alias("doc_id"), (F.col("line_no") - parts[1].cast("bigint")).alias("start")
    )
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        ((F.min("start") == F.max("start")) & (F.min("file") == F.max("file"))).alias("in_order"),
    )


@query(
    "csv_cells_roundtrip",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', "' || p_brand || '"' AS name, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS large,
      p_type || ';;' || p_size AS cells FROM part
    """,
)
def _csv_cells_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("name"),
        (F.col("p_size") > 25).alias("large"),
        F.array("p_type", F.lit(None).cast("string"), F.col("p_size").cast("string")).alias("cells"),
    )
    path = fresh_folder(spark)
    write_csv_flat(rows, path)
    return spark.read.option("escape", '"').csv(path, header=True, schema="id string, name string, large string, cells string")


@query(
    "json_lines_roundtrip",
    """
    SELECT CAST(s_suppkey AS INT) AS npc_id, s_name AS npc_name, CAST(NULL AS VARCHAR) AS shop_name, CAST(0 AS BIGINT) AS part,
      s_nationkey || ':' || n_name AS offer FROM supplier JOIN nation ON n_nationkey = s_nationkey
    """,
)
def _json_lines_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    shops = joined.select(
        F.col("s_suppkey").cast("int").alias("npc_id"),
        F.col("s_name").alias("npc_name"),
        F.lit(None).cast("string").alias("shop_name"),
        F.array(
            F.struct(
                F.col("s_nationkey").cast("int").alias("item_id"), F.col("n_name").alias("name"), F.lit(1).alias("buy_price"),
                F.array().cast("array<string>").alias("conditions"),
            )
        ).alias("items"),
    )
    path = fresh_folder(spark)
    write_json(public_names(shops, "npc_shops"), path)
    offer = "ItemId INT, Name STRING, BuyPrice INT, Conditions ARRAY<STRING>"
    read = spark.read.schema(f"NpcId INT, NpcName STRING, ShopName STRING, Part BIGINT, Items ARRAY<STRUCT<{offer}>>").json(path)
    return read.select(
        F.col("NpcId").alias("npc_id"), F.col("NpcName").alias("npc_name"), F.col("ShopName").alias("shop_name"),
        F.col("Part").alias("part"), F.concat_ws(":", F.col("Items")[0]["ItemId"], F.col("Items")[0]["Name"]).alias("offer"),
    )


@query(
    "typed_table_or_empty",
    """
    SELECT 'orders' AS source, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS warning FROM orders
    UNION ALL SELECT 'absent', 0, 'missing table' UNION ALL SELECT 'broken', 0, 'unreadable table'
    """,
)
def _typed_table_or_empty(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark)
    table(spark, folder, "orders").select("o_orderkey").write.parquet(f"{path}/orders")
    write_text_file(spark, f"{path}/broken/part-0.parquet", "no table")
    out = None
    for name in ("orders", "absent", "broken"):
        rows, warning = read_table(spark, f"{path}/{name}", table(spark, folder, "orders").select("o_orderkey").schema)
        kind = warning.split(":")[0] if warning else None
        part = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("source"), "n_rows", F.lit(kind).cast("string").alias("warning")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("internal_name"),
        F.col("p_size").cast("int").alias("value"), F.lit(1).alias("sell_price"),
    )


def _broken(spark: SparkSession) -> DataFrame:
    raise RuntimeError("no source")


@query(
    "run_log_summary",
    """
    SELECT run_id, phase, outcome, CASE WHEN phase = 'items' THEN (SELECT count(*) FROM part) ELSE 0 END AS row_count,
      n_errors, CAST(n_passed AS BIGINT) AS n_passed, CAST(n_failed AS BIGINT) AS n_failed
    FROM (VALUES ('a', 'items', 'PASS', 0, 1, 0), ('b', 'items', 'PASS', 0, 1, 2), ('b', 'shimmer', 'FAIL', 3, 1, 2),
      ('b', 'recipes', 'FAIL', 1, 1, 2)) t(run_id, phase, outcome, n_errors, n_passed, n_failed)
    """,
)
def _run_log_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs into one log: totals are those of a run; a phase without rows and one that raises (and so has no outputs) fail."""
    path = fresh_folder(spark)
    items = {"items": lambda s: _items(s, folder)}
    run_catalog(spark, catalog_phases(items), path, "a")
    empty = {"recipes": lambda s: s.createDataFrame([], RECIPES), "shimmer": _broken}
    run_catalog(spark, catalog_phases(items | empty), path, "b")
    log = read_run_log(spark, f"{path}/run_log")
    return phase_summary(log).join(phase_totals(log), "run_id").select(
        "run_id", F.col("phase_name").alias("phase"), "outcome", "row_count", F.size("errors").alias("n_errors"), "n_passed", "n_failed"
    )


@query(
    "placeholder_outputs",
    """
    SELECT 'before' AS run, count(*) AS n_json, true AS has_table, true AS has_csv FROM part
    UNION ALL SELECT 'failed', 0, false, true
    """,
)
def _placeholder_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs of a good run, and after a run of the same phase that fails."""
    path, out = fresh_folder(spark), None
    for run, build in (("before", lambda s: _items(s, folder)), ("failed", _broken)):
        run_phase(spark, Phase("items", "items", build), path)
        read = spark.read.schema("Id INT").json(f"{path}/items.json").filter("Id IS NOT NULL")
        n = read.count()
        row = (run, n, path_exists(spark, f"{path}/items.parquet"), path_exists(spark, f"{path}/items.csv"))
        part = spark.createDataFrame([row], "run string, n_json bigint, has_table boolean, has_csv boolean")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "catalog_validation",
    """
    WITH e AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem),
    ids AS (SELECT p_partkey AS id FROM part),
    fk AS (
      SELECT count(*) FILTER (WHERE a NOT IN (SELECT id FROM ids)) + count(*) FILTER (WHERE b NOT IN (SELECT id FROM ids)) AS n FROM e),
    shop AS (SELECT count(*) AS n FROM supplier WHERE s_nationkey NOT IN (SELECT id FROM ids)),
    pic AS (SELECT count(*) AS n FROM part)
    SELECT 'required_files' AS section, true AS pass, CAST(0 AS BIGINT) AS n_failing
    UNION ALL SELECT 'count_ranges', true, 0
    UNION ALL SELECT 'foreign_key_integrity', fk.n + shop.n = 0, CAST(fk.n + shop.n AS BIGINT) FROM fk, shop
    UNION ALL SELECT 'sprite_manifest_integrity', false, CAST(pic.n + (SELECT count(*) FROM part WHERE p_size % 10 = 0) AS BIGINT) FROM pic
    UNION ALL SELECT 'spot_checks', false, CAST(2 AS BIGINT) - (SELECT CAST(bool_or(s_suppkey = 17 AND s_nationkey = 8) AS BIGINT) FROM supplier)
      + CAST(1 AS BIGINT) - (SELECT CAST(count(*) > 0 AS BIGINT) FROM part WHERE p_partkey = 8)
    """,
)
def _catalog_validation(spark: SparkSession, folder: str) -> DataFrame:
    """All five datasets from the tables, run, written, read back and validated; the failures of each section."""

    def edges(s: SparkSession) -> DataFrame:
        return table(s, folder, "lineitem").select(
            F.col("l_partkey").cast("int").alias("input_item_id"), F.lit("in").alias("input_item_name"),
            F.col("l_suppkey").cast("int").alias("output_item_id"), F.lit("out").alias("output_item_name"),
            F.col("l_quantity").cast("int").alias("output_amount"), F.lit("deconstruct").alias("type"),
        )

    def recipes(s: SparkSession) -> DataFrame:
        """Each part is made of parts 9 and 23, each of them in a part of its own."""
        one = table(s, folder, "part").select("p_partkey", F.explode(F.array(F.lit(9), F.lit(23))).alias("i"))
        rows = one.select(
            F.col("p_partkey").cast("int").alias("recipe_index"), F.when(F.col("i") == 9, 0).otherwise(1).cast("bigint").alias("part"),
            F.col("p_partkey").cast("int").alias("result_item_id"), F.lit("x").alias("result_item_name"), F.lit(1).alias("result_amount"),
            F.array(F.struct(F.col("i").alias("item_id"), F.lit("y").alias("name"), F.lit(1).alias("count"))).alias("ingredients"),
            F.array().cast("array<string>").alias("crafting_stations"), F.array().cast("array<string>").alias("conditions"),
        )
        return rows.select(*RECIPES.fieldNames())

    def shops(s: SparkSession) -> DataFrame:
        return table(s, folder, "supplier").select(
            F.col("s_suppkey").cast("int").alias("npc_id"), F.col("s_name").alias("npc_name"), F.lit("shop").alias("shop_name"),
            F.lit(0).cast("bigint").alias("part"),
            F.array(
                F.struct(
                    F.col("s_nationkey").cast("int").alias("item_id"), F.lit("z").alias("name"), F.lit(5).alias("buy_price"),
                    F.array().cast("array<string>").alias("conditions"),
                )
            ).alias("items"),
        ).select(*SHOPS.fieldNames())

    def sprites(s: SparkSession) -> DataFrame:
        """No picture exists; every tenth size has a width of zero."""
        return table(s, folder, "part").select(
            F.col("p_partkey").cast("int").alias("id"), F.lit("item").alias("category"), F.col("p_name").alias("internal_name"),
            F.concat(F.lit("sprites/items/Item_"), "p_partkey", F.lit(".png")).alias("sprite_file"),
            F.when(F.col("p_size") % 10 == 0, 0).otherwise(1).alias("width"), F.lit(1).alias("height"),
        ).select(*MANIFEST.fieldNames())

    path = fresh_folder(spark)
    builders = {"items": lambda s: _items(s, folder), "recipes": recipes, "shimmer": edges, "npc_shops": shops, "sprites": sprites}
    run_catalog(spark, catalog_phases(builders), path)
    ranges = tuple(RangeCheck(n, 0) for n in ("items_range", "recipes_range", "shimmer_deconstruct_range", "npc_shops_min", "sprite_items_min"))
    ranges += tuple(RangeCheck(n, 0) for n in ("shimmer_item_transform_range", "sprite_manifest_range", "sprite_npcs_min"))
    report = build_report(spark, path, validate_catalog(spark, path, ranges), f"{path}/failures")
    rows = []
    for section, found in report["checks"].items():
        failing = found["failingRecords"]
        rows.append((section, found["pass"], failing["count"] if isinstance(failing, dict) else len(failing)))
    return spark.createDataFrame(rows, "section string, pass boolean, n_failing bigint")
