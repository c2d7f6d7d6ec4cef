"""Projections, names, lists and text.

Inputs of the catalog are read off the star schema: a part is an item, an order is a recipe whose
ingredients are its line items, a supplier is a vendor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions import (
    category_rank,
    contains_all,
    encode_ingredient,
    encode_offer,
    fallback_label,
    file_name,
    file_stem,
    flags_to_labels,
    is_plausible_id,
    is_valid_reference,
    lenient_bool,
    lenient_int,
    lenient_long,
    list_to_cell,
    manifest_path,
    nested_size,
    normalize_category,
    normalize_condition,
    normalize_path,
    parse_numeric_id,
    resolve_name,
    stop_position,
    take_while,
)
from stockloom.functions.names import (
    EDGE_ITEM_LABEL,
    NPC_ASSET_LABEL,
    RECIPE_ITEM_LABEL,
    STATION_LABEL,
    UNLOCALIZED_PREFIX,
    VENDOR_ITEM_LABEL,
    VENDOR_LABEL,
)
from stockloom.operators.checks import contains_all_rows
from stockloom.operators.dedupe import dedupe_first, ordered_distinct_list
from stockloom.operators.lookups import first_wins_map, lookup_left
from stockloom.operators.nesting import (
    distinct_over_samples,
    nest_children,
    take_while_rows,
)
from stockloom.plans.catalog import item_catalog, recipe_catalog
from stockloom.queries.registry import query, table
from stockloom.schemas import INT, RECIPE_FLAGS, struct
from stockloom.operators.scans import materialize
from stockloom.sources.arrays import as_typed

SQL_LOCALIZED = """CASE p_type WHEN 'ECONOMY' THEN '' WHEN 'SMALL' THEN 'ItemName.' || p_name
    WHEN 'PROMO' THEN NULL WHEN 'LARGE' THEN '  ' ELSE p_name END"""
SQL_INTERNAL = "CASE WHEN p_size <= 45 THEN p_brand || '/' || p_type WHEN p_size <= 48 THEN ' ' END"


def localized_name() -> Column:
    """A name that is empty, unlocalised, null, blank or usable, depending on the part's type."""
    return (
        F.when(F.col("p_type") == "ECONOMY", "")
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("ItemName."), "p_name"))
        .when(F.col("p_type") == "PROMO", F.lit(None))
        .when(F.col("p_type") == "LARGE", "  ")
        .otherwise(F.col("p_name"))
    )


def internal_name() -> Column:
    return F.when(F.col("p_size") <= 45, F.concat("p_brand", F.lit("/"), "p_type")).when(
        F.col("p_size") <= 48, " "
    )


def part_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("id"),
        localized_name().alias("localized_name"),
        internal_name().alias("internal_name"),
    )


@query(
    "item_catalog",
    f"""
    WITH raw AS (
      SELECT CAST(p_partkey AS INT) AS id,
        CAST(round((p_retailprice - 950) * 100) AS INT) AS value,
        {SQL_LOCALIZED} AS display_name, {SQL_INTERNAL} AS internal_name
      FROM part)
    SELECT id,
      coalesce(CASE WHEN trim(coalesce(display_name, '')) = '' OR starts_with(display_name, 'ItemName.')
        THEN internal_name ELSE display_name END, '') AS name,
      coalesce(internal_name, '') AS internal_name, value, CAST(value // 5 AS INT) AS sell_price
    FROM raw WHERE id >= 1
    """,
)
def _item_catalog(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    raw = part.select(
        F.col("p_partkey").cast("int").alias("id"),
        F.round((F.col("p_retailprice") - 950) * 100).cast("int").alias("value"),
        localized_name().alias("display_name"),
    )
    names = part.filter(internal_name().isNotNull()).select(
        F.col("p_partkey").cast("int").alias("id"), internal_name().alias("internal_name")
    )
    return item_catalog(raw, names)


@query(
    "name_fallback_chain",
    f"""
    WITH n AS (SELECT CAST(p_partkey AS INT) AS id, {SQL_LOCALIZED} AS l, {SQL_INTERNAL} AS i FROM part),
    b AS (SELECT id, l, CASE WHEN trim(l) <> '' THEN l END AS lo,
      CASE WHEN trim(i) <> '' THEN i END AS im FROM n)
    SELECT id, coalesce(lo, 'ItemID.' || id) AS recipe_name,
      coalesce(lo, im, 'Item_' || id) AS edge_name,
      coalesce(CASE WHEN NOT starts_with(l, 'ItemName.') THEN lo END, im, 'Item ' || id) AS offer_name,
      coalesce(lo, im, 'NPC ' || id) AS vendor_name,
      coalesce(im, 'Item_' || id) AS item_asset_name, 'NPC_' || id AS npc_asset_name,
      coalesce(lo, 'TileID.' || id) AS station_name
    FROM b
    """,
)
def _name_fallback_chain(spark: SparkSession, folder: str) -> DataFrame:
    id_col, localized, internal = F.col("id"), F.col("localized_name"), F.col("internal_name")
    return part_names(spark, folder).select(
        "id",
        resolve_name(localized, label=RECIPE_ITEM_LABEL, id_col=id_col).alias("recipe_name"),
        resolve_name(localized, internal, label=EDGE_ITEM_LABEL, id_col=id_col).alias("edge_name"),
        resolve_name(
            localized, internal, label=VENDOR_ITEM_LABEL, id_col=id_col, bad_prefix=UNLOCALIZED_PREFIX
        ).alias("offer_name"),
        resolve_name(localized, internal, label=VENDOR_LABEL, id_col=id_col).alias("vendor_name"),
        resolve_name(internal, label=EDGE_ITEM_LABEL, id_col=id_col).alias("item_asset_name"),
        fallback_label(NPC_ASSET_LABEL, id_col).alias("npc_asset_name"),
        resolve_name(localized, label=STATION_LABEL, id_col=id_col).alias("station_name"),
    )


@query(
    "asset_name_lookup",
    """
    WITH names AS (
      SELECT id, coalesce(name, '') AS name FROM (
        SELECT p_size AS id, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_name END AS name,
          row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rn
        FROM part WHERE p_size <= 40 AND p_size > 0) WHERE rn = 1)
    SELECT CAST(l_quantity AS INT) AS id,
      CASE WHEN trim(coalesce(name, '')) = '' THEN 'Item_' || CAST(l_quantity AS INT) ELSE name END
        AS internal_name,
      count(*) AS n_lines
    FROM lineitem LEFT JOIN names ON names.id = CAST(l_quantity AS INT) GROUP BY ALL
    """,
)
def _asset_name_lookup(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").filter("p_size <= 40")
    named = part.select(
        F.col("p_size").alias("id"),
        F.when(F.col("p_type") == "PROMO", F.lit(None)).otherwise(F.col("p_name")).alias("name"),
        "p_partkey",
    )
    names = first_wins_map(named, "id", "name", ["p_partkey"])
    # Counted per id first: the lookup then meets each id once.
    used = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_quantity").cast("int").alias("id"))
        .agg(F.count("*").alias("n_lines"))
    )
    found = lookup_left(used, names, "id", {"name": "_name"})
    return found.select(
        "id",
        resolve_name(F.col("_name"), label=EDGE_ITEM_LABEL, id_col=F.col("id")).alias("internal_name"),
        "n_lines",
    )


@query(
    "take_while_items",
    """
    WITH a AS (
      SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) BETWEEN 0 AND CAST(0.02 AS DOUBLE) THEN NULL
        ELSE CAST(round(CAST(x AS DOUBLE) * 1000) AS INT) END) AS arr FROM embeddings),
    p AS (SELECT vec_id, arr,
      coalesce(list_position(list_transform(arr, lambda x: coalesce(x <= -200, false)), true), 0) AS stop
      FROM a),
    k AS (SELECT vec_id, stop, CASE WHEN stop = 0 THEN arr ELSE arr[1:stop - 1] END AS kept FROM p)
    SELECT vec_id, CAST(stop AS BIGINT) AS stop_at,
      CAST(len(list_filter(kept, lambda x: x IS NOT NULL)) AS INT) AS n_kept,
      coalesce(array_to_string(list_filter(kept, lambda x: x IS NOT NULL), ';'), '') AS kept,
      coalesce(array_to_string(list_transform(kept, lambda x: coalesce(CAST(x AS VARCHAR), '')), ';'), '')
        AS kept_with_nulls
    FROM k
    """,
)
def _take_while_items(spark: SparkSession, folder: str) -> DataFrame:
    arr = F.transform(
        "embedding",
        lambda x: F.when(
            ~x.cast("double").between(0, 0.02), F.round(x.cast("double") * 1000).cast("int")
        ),
    )
    rows = table(spark, folder, "embeddings").select("vec_id", arr.alias("arr"))

    def stop(x: Column) -> Column:
        return x <= -200

    kept = take_while(F.col("arr"), stop)
    with_nulls = take_while(F.col("arr"), lambda x: stop(F.coalesce(x, F.lit(0))), skip_null=False)
    return rows.select(
        "vec_id",
        stop_position(F.col("arr"), stop).alias("stop_at"),
        nested_size(kept).alias("n_kept"),
        list_to_cell(kept.cast("array<string>")).alias("kept"),
        list_to_cell(with_nulls.cast("array<string>")).alias("kept_with_nulls"),
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(
    "take_while_rows",
    """
    WITH s AS (
      SELECT *, bool_or(l_quantity > 40) OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
        RANGE UNBOUNDED PRECEDING) AS stopped
      FROM lineitem)
    SELECT l_orderkey, count(*) AS n_kept, sum(l_quantity) AS quantity
    FROM s WHERE NOT stopped GROUP BY l_orderkey
    """,
)
def _take_while_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", *LINE_ORDER)
    kept = take_while_rows(lines, ["l_orderkey"], LINE_ORDER, F.col("l_quantity") > 40)
    return kept.groupBy("l_orderkey").agg(
        F.count("*").alias("n_kept"), F.sum("l_quantity").alias("quantity")
    )


# One predicate per recipe flag, in label order.
FLAG_TESTS: tuple[str, ...] = (
    "l_returnflag = 'R'",
    "l_returnflag = 'A'",
    "l_returnflag = 'N'",
    "l_linestatus = 'O'",
    "l_linestatus = 'F'",
    "l_quantity > 40",
    "l_quantity < 10",
    "l_discount >= 0.05",
    "l_discount = 0",
    "l_tax >= 0.04",
    "l_tax = 0",
    "l_linenumber = 1",
    "l_linenumber >= 5",
    "l_extendedprice > 50000",
    "l_extendedprice < 1000",
)
_SQL_LABELS = " || ".join(
    f"CASE WHEN {test} THEN ';{label}' ELSE '' END"
    for test, (_, label) in zip(FLAG_TESTS, RECIPE_FLAGS, strict=True)
)


@query(
    "flags_to_labels",
    f"""SELECT substr({_SQL_LABELS}, 2) AS labels, count(*) AS n_lines FROM lineitem GROUP BY 1""",
)
def _flags_to_labels(spark: SparkSession, folder: str) -> DataFrame:
    flags = [
        (F.expr(test), label) for test, (_, label) in zip(FLAG_TESTS, RECIPE_FLAGS, strict=True)
    ]
    labels = list_to_cell(flags_to_labels(flags))
    return table(spark, folder, "lineitem").groupBy(labels.alias("labels")).agg(
        F.count("*").alias("n_lines")
    )


def recipe_slots(spark: SparkSession, folder: str) -> DataFrame:
    """(recipe_index, item, type, name, stack): one row per order and part, before the stop rule.

    Repeats of a part in an order are added up first, so an order holds each part once.
    """
    lines = table(spark, folder, "lineitem")
    quantity = F.sum("l_quantity").cast("int")
    grouped = lines.groupBy(
        F.col("l_orderkey").cast("int").alias("recipe_index"), F.col("l_partkey").alias("item")
    ).agg(quantity.alias("stack"))
    return grouped.select(
        "recipe_index",
        "item",
        F.when(F.col("stack") > 45, 0).otherwise(F.col("item")).cast("int").alias("type"),
        F.when(F.col("stack") < 40, F.concat(F.lit("part "), F.col("item"))).alias("name"),
        "stack",
    )


_SQL_SLOTS = """slots AS (
      SELECT CAST(l_orderkey AS INT) AS recipe_index, l_partkey AS item,
        CAST(sum(l_quantity) AS INT) AS stack FROM lineitem GROUP BY ALL),
    kept AS (
      SELECT recipe_index, item, CAST(item AS INT) AS type, stack,
        CASE WHEN stack < 40 THEN 'part ' || item ELSE 'ItemID.' || item END AS name
      FROM (SELECT *, bool_or(stack > 45 OR item = 0) OVER (PARTITION BY recipe_index ORDER BY item) AS stopped
            FROM slots) WHERE NOT stopped)"""
_SQL_TILES = """CASE WHEN o_totalprice < 100000 THEN '' WHEN o_totalprice < 200000 THEN 'Status ' || o_orderstatus
      ELSE 'Status ' || o_orderstatus || ';TileID.7' END"""


@query(
    "recipe_projection",
    f"""
    WITH {_SQL_SLOTS},
    nested AS (SELECT recipe_index,
      string_agg(type || ':' || name || 'x' || stack, ';' ORDER BY item) AS ingredients FROM kept GROUP BY 1)
    SELECT CAST(o_orderkey AS INT) AS recipe_index, CAST(0 AS BIGINT) AS part,
      CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(o_custkey AS INT) END AS result_item_id,
      CASE WHEN o_orderstatus = 'F' THEN 'for ' || o_custkey
        WHEN o_orderstatus = 'O' THEN 'ItemID.' || o_custkey END AS result_item_name,
      CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END AS result_amount,
      coalesce(ingredients, '') AS ingredients, {_SQL_TILES} AS crafting_stations,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'Water;CrimsonWorld'
        WHEN o_orderpriority = '2-HIGH' THEN 'AlchemyTable' ELSE '' END AS conditions
    FROM orders LEFT JOIN nested ON o_orderkey = recipe_index
    """,
)
def _recipe_projection(spark: SparkSession, folder: str) -> DataFrame:
    # Read twice, for the stops and for the rows before them.
    slots = take_while_rows(
        materialize(recipe_slots(spark, folder)), ["recipe_index"], ["item"], F.col("type") <= 0
    )
    priority, status, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    customer = F.col("o_custkey").cast("int")
    result = F.when(
        status != "P",
        F.struct(
            customer.alias("type"),
            F.when(status == "F", F.concat(F.lit("for "), customer.cast("string"))).alias("name"),
            F.lit(2).alias("stack"),
        ),
    )
    tiles = (
        F.when(price < 100_000, F.array(F.lit(-1), F.lit(3)))
        .when(price < 200_000, F.array(F.ascii(status), F.lit(-1), F.lit(9)))
        .otherwise(F.array(F.ascii(status), F.lit(7)))
    )
    flags = {
        "need_water": priority == "1-URGENT",
        "alchemy": priority == "2-HIGH",
        "crimson": priority == "1-URGENT",
    }
    recipes = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("int").alias("recipe_index"),
        result.alias("result"),
        tiles.alias("required_tiles"),
        *[flags.get(flag, F.lit(False)).alias(flag) for flag, _ in RECIPE_FLAGS],
    )
    nested = nest_children(
        recipes, slots, ["recipe_index"], "item", ["type", "name", "stack"], "required_items"
    )
    raw = lookup_left(
        nested,
        recipes,
        "recipe_index",
        {c: c for c in recipes.columns if c != "recipe_index"},
    )
    tile_names = table(spark, folder, "orders").select(
        F.ascii("o_orderstatus").alias("tile_id"),
        F.concat(F.lit("Status "), "o_orderstatus").alias("name"),
    )
    out = recipe_catalog(
        raw,
        first_wins_map(tile_names, "tile_id", "name", ["name"]),
        extra=["part"],
        tile_lists=recipes,
    )
    return out.select(
        "recipe_index",
        "part",
        "result_item_id",
        "result_item_name",
        "result_amount",
        list_to_cell(F.transform("ingredients", encode_ingredient)).alias("ingredients"),
        list_to_cell(F.col("crafting_stations")).alias("crafting_stations"),
        list_to_cell(F.col("conditions")).alias("conditions"),
    )


@query(
    "encode_cells",
    """
    WITH g AS (
      SELECT l_suppkey AS supplier, l_partkey AS item, CAST(sum(l_quantity) AS INT) AS n,
        CAST(max(l_linenumber) AS INT) AS price, bool_or(l_returnflag = 'R') AS r,
        bool_or(l_linestatus = 'O') AS o FROM lineitem GROUP BY ALL)
    SELECT supplier, k // 256 AS part,
      string_agg(item || ':' || CASE WHEN n > 60 THEN '' ELSE 'p' || item END || 'x' || n, ';' ORDER BY item)
        AS ingredients,
      string_agg(item || '|' || CASE WHEN n > 60 THEN '' ELSE 'p' || item END || '|' || price || '|' ||
        CASE WHEN r AND o THEN 'returned&open' WHEN r THEN 'returned' WHEN o THEN 'open' ELSE '' END,
        ';' ORDER BY item) AS offers
    FROM (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY item) - 1 AS k FROM g) GROUP BY ALL
    """,
)
def _encode_cells(spark: SparkSession, folder: str) -> DataFrame:
    grouped = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("item_id"))
        .agg(
            F.sum("l_quantity").cast("int").alias("count"),
            F.max("l_linenumber").alias("buy_price"),
            F.bool_or(F.col("l_returnflag") == "R").alias("r"),
            F.bool_or(F.col("l_linestatus") == "O").alias("o"),
        )
    )
    named = grouped.withColumn(
        "name", F.when(F.col("count") <= 60, F.concat(F.lit("p"), F.col("item_id").cast("string")))
    ).withColumn("conditions", flags_to_labels([(F.col("r"), "returned"), (F.col("o"), "open")]))
    nested = nest_children(
        None, named, ["supplier"], "item_id",
        ["item_id", "name", "count", "buy_price", "conditions"], "entries", part_width=256,
    )
    return nested.select(
        "supplier",
        "part",
        list_to_cell(F.transform("entries", encode_ingredient)).alias("ingredients"),
        list_to_cell(F.transform("entries", encode_offer)).alias("offers"),
    )


@query(
    "numeric_id_from_path",
    r"""
    SELECT page_id, name, CAST(id AS INT) AS id, 'sprites/npcs/' || regexp_replace(name, '\.[^.]*$', '') || '.png'
      AS sprite_file
    FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS name,
      TRY_CAST(regexp_extract(regexp_extract(url, '[^/]*$'), '^([0-9]+)\.html$', 1) AS INT) AS id FROM pages)
    WHERE id IS NOT NULL
    """,
)
def _numeric_id_from_path(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "pages").select("page_id", file_name(F.col("url")).alias("name"))
    parsed = names.withColumn("id", parse_numeric_id(F.col("name"), "", ".html"))
    return parsed.filter(F.col("id").isNotNull()).select(
        "page_id", "name", "id", manifest_path("npcs", file_stem(F.col("name"))).alias("sprite_file")
    )


_SQL_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(
    "normalize_text",
    rf"""
    SELECT doc_id, md5(regexp_replace(replace(replace(
        regexp_replace('Main.LocalPlayer.zone ' || text, '^{_SQL_WS}|{_SQL_WS}$', '', 'g'),
        'Main.player[Main.myPlayer].', 'player.'), 'Main.LocalPlayer.', 'player.'), '{_SQL_WS}', ' ', 'g'))
        AS condition_md5,
      lang AS category, source || '/' || lang AS path
    FROM documents
    """,
)
def _normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        F.md5(
            normalize_condition(F.concat(F.lit("Main.LocalPlayer.zone "), "text")).cast("binary")
        ).alias("condition_md5"),
        normalize_category(F.concat(F.lit(" \t"), F.upper("lang"), F.lit("\n"))).alias("category"),
        normalize_path(F.concat(F.lit("\\/"), "source", F.lit("\\"), "lang")).alias("path"),
    )


@query(
    "dedupe_first_wins",
    """
    SELECT doc_id, lang, source, n_chars FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
    """,
)
def _dedupe_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    # Whole texts are compared by their SHA-256, so the shuffle does not carry them.
    documents = table(spark, folder, "documents").select(
        F.sha2("text", 256).alias("digest"), "doc_id", "lang", "source", "n_chars"
    )
    return dedupe_first(documents, ["digest"], ["doc_id"]).drop("digest")


@query(
    "ordered_distinct_list",
    """
    WITH f AS (SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY ALL)
    SELECT user_id, string_agg(event_type, '>' ORDER BY place) AS first_seen FROM f GROUP BY 1
    """,
)
def _ordered_distinct_list(spark: SparkSession, folder: str) -> DataFrame:
    lists = ordered_distinct_list(
        table(spark, folder, "events"), ["user_id"], "event_type", ["event_id"], "types"
    )
    return lists.select("user_id", F.array_join("types", ">").alias("first_seen"))


@query(
    "distinct_over_samples",
    """
    SELECT CAST(user_id AS INT) AS item_id, count(DISTINCT CAST(ts AS DATE)) AS n_samples
    FROM events WHERE event_type <> 'error' AND user_id > 0 GROUP BY 1
    """,
)
def _distinct_over_samples(spark: SparkSession, folder: str) -> DataFrame:
    rolls = table(spark, folder, "events").select(
        F.to_date("ts").alias("sample"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.col("user_id").cast("string")))
        .otherwise(F.col("user_id").cast("string"))
        .alias("item_id"),
    )
    return distinct_over_samples(rolls)


@query(
    "contains_all",
    """
    SELECT doc_id, CAST(len(string_split(text, ' ')) AS INT) AS n_words FROM documents
    WHERE list_has_all(string_split(text, ' '), ['the', 'and', 'of'])
    """,
)
def _contains_all(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return words.filter(contains_all(F.col("words"), ["the", "and", "of"])).select(
        "doc_id", nested_size(F.col("words")).alias("n_words")
    )


@query(
    "contains_all_rows",
    """
    SELECT l_partkey FROM lineitem WHERE l_quantity IN (9, 23) GROUP BY 1
    HAVING count(DISTINCT l_quantity) = 2
    """,
)
def _contains_all_rows(spark: SparkSession, folder: str) -> DataFrame:
    return contains_all_rows(table(spark, folder, "lineitem"), ["l_partkey"], "l_quantity", [9, 23])


@query(
    "lenient_parse",
    r"""
    SELECT event_id, coalesce(TRY_CAST(r AS INT), 0) AS as_int, coalesce(TRY_CAST(r AS BIGINT), 0) AS as_long,
      event_type = 'click' AS as_bool
    FROM (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'x' ELSE '' END ||
      regexp_extract(props, '"k": ([0-9]+)', 1) AS r FROM events)
    """,
)
def _lenient_parse(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(
        F.when(F.col("event_type") == "error", "x").otherwise(""), F.get_json_object("props", "$.k")
    )
    word = F.when(F.col("event_type") == "click", " True ").otherwise(F.col("event_type"))
    return table(spark, folder, "events").select(
        "event_id",
        lenient_int(raw).alias("as_int"),
        lenient_long(raw).alias("as_long"),
        lenient_bool(word).alias("as_bool"),
    )


@query(
    "valid_references",
    """
    SELECT CAST(p_partkey * 20 - 1000 AS INT) AS id, p_partkey * 20 - 1000 BETWEEN 1000 AND 1500 AS plausible,
      CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END AS rank
    FROM part WHERE p_partkey * 20 - 1000 > 0
    """,
)
def _valid_references(spark: SparkSession, folder: str) -> DataFrame:
    shifted = table(spark, folder, "part").select(
        (F.col("p_partkey") * 20 - 1000).cast("int").alias("id"),
        F.when(F.col("p_type") == "PROMO", "item").otherwise("npc").alias("category"),
    )
    return shifted.filter(is_valid_reference(F.col("id"))).select(
        "id",
        is_plausible_id(F.col("id"), F.lit(1500)).alias("plausible"),
        category_rank(F.col("category")).alias("rank"),
    )


@query(
    "typed_json_records",
    r"""
    SELECT event_id, event_type <> 'error' AS is_object,
      CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) END AS k
    FROM events
    """,
)
def _typed_json_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as one record of a JSON array: an integer, a text or a bare number."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    text = (
        F.when(kind == "error", k)
        .when(kind == "view", F.concat(F.lit('{"k": "'), k, F.lit('"}')))
        .otherwise(F.col("props"))
    )
    variant = F.try_parse_json(text)
    records = table(spark, folder, "events").select(
        F.col("event_id").alias("pos"),
        F.schema_of_variant(variant).startswith("OBJECT").alias("is_object"),
        variant.alias("record"),
    )
    typed = as_typed(records, struct(k=INT))
    return typed.withColumnRenamed("pos", "event_id")
