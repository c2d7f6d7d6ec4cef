"""Vendor inventories: a supplier is a shop, its line items are the slots of its shelf."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions import encode_offer, list_to_cell
from stockloom.operators.dedupe import first_nonempty_source
from stockloom.operators.lookups import lookup_left
from stockloom.operators.nesting import distinct_set, nest_children, sum_nested_sizes
from stockloom.operators.shops import (
    offer_names,
    parsed_condition_lists,
    shop_catalog,
    shop_items,
    with_npc_names,
)
from stockloom.queries.catalog import SQL_INTERNAL, internal_name
from stockloom.queries.registry import query, table


def slots(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as shelf slots; the slot is a tuple, since order and line number repeat."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("shop_id"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("slot"),
        F.col("l_partkey").cast("int").alias("item_id"),
        (F.col("l_quantity") == 13).alias("is_air"),
        F.when(F.col("l_quantity") > 40, "ItemName.x")
        .when(F.col("l_quantity") > 30, " ")
        .otherwise(F.concat(F.lit("line "), "l_linenumber"))
        .alias("name"),
        F.round(F.col("l_extendedprice")).cast("int").alias("buy_price"),
        F.when(F.col("l_returnflag") == "R", 1)
        .when(F.col("l_returnflag") == "A", 0)
        .otherwise(-1)
        .alias("special_currency"),
    )


def conditions(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").filter("l_tax >= 0.05")
    return lines.select(
        F.col("l_suppkey").cast("int").alias("shop_id"),
        F.col("l_partkey").cast("int").alias("item_id"),
        F.concat(F.lit("status "), "l_linestatus").alias("condition"),
        "l_orderkey",
        "l_linenumber",
        "l_linestatus",
    )


def internal_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("id"), internal_name().alias("internal_name")
    )


SQL_OFFERS = f"""
    raw AS (
      SELECT CAST(l_suppkey AS INT) AS shop, CAST(l_partkey AS INT) AS item, l_orderkey AS s1, l_linenumber AS s2,
        l_extendedprice AS s3, l_quantity AS s4,
        CASE WHEN l_quantity > 40 THEN 'ItemName.x' WHEN l_quantity > 30 THEN ' ' ELSE 'line ' || l_linenumber END AS name,
        CAST(round(l_extendedprice) AS INT) AS price,
        CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS currency
      FROM lineitem WHERE l_quantity <> 13 AND l_partkey > 0),
    slots AS (SELECT *, row_number() OVER (PARTITION BY shop, item ORDER BY s1, s2, s3, s4) AS slot FROM raw),
    first AS (SELECT * FROM slots WHERE slot = 1),
    parsed AS (
      SELECT CAST(l_suppkey AS INT) AS shop, CAST(l_partkey AS INT) AS item, 'status ' || l_linestatus AS cond,
        row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_linestatus) AS ord
      FROM lineitem WHERE l_tax >= 0.05),
    conds AS (
      SELECT shop, item, 'specialCurrency=' || currency AS cond, slot AS a, 0 AS b FROM slots WHERE currency >= 0
      UNION ALL SELECT shop, item, cond, 1, ord FROM parsed),
    ranked AS (SELECT shop, item, cond, min((a, b)) AS place FROM conds GROUP BY ALL),
    lists AS (SELECT shop, item, string_agg(cond, '&' ORDER BY place) AS conditions FROM ranked GROUP BY ALL),
    inames AS (SELECT CAST(p_partkey AS INT) AS id, {SQL_INTERNAL} AS iname FROM part),
    offers AS (
      SELECT first.shop, first.item, coalesce(
          CASE WHEN trim(name) <> '' AND NOT starts_with(name, 'ItemName.') THEN name END,
          CASE WHEN trim(iname) <> '' THEN iname END, 'Item ' || first.item) AS name,
        price, coalesce(conditions, '') AS conditions
      FROM first LEFT JOIN lists ON lists.shop = first.shop AND lists.item = first.item
        LEFT JOIN inames ON inames.id = first.item)"""


@query(
    "shop_items",
    f"""WITH {SQL_OFFERS}
    SELECT shop AS shop_id, item AS item_id, name, price AS buy_price, conditions FROM offers""",
)
def _shop_items(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parsed_condition_lists(conditions(spark, folder))
    offers = offer_names(shop_items(slots(spark, folder), parsed), internal_names(spark, folder))
    return offers.select(
        "shop_id", "item_id", "name", "buy_price", F.array_join("conditions", "&").alias("conditions")
    )


@query(
    "nested_shops_summary",
    """
    WITH d AS (SELECT DISTINCT l_suppkey AS shop_id, l_partkey AS item FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY item) - 1 AS k FROM d),
    n AS (SELECT shop_id, k // 512 AS part, count(*) AS n_items, min(item) AS first_item, max(item) AS last_item
      FROM r GROUP BY ALL),
    h AS (SELECT c_custkey AS shop_id, 0 AS part FROM customer UNION SELECT shop_id, part FROM n)
    SELECT h.shop_id, CAST(h.part AS BIGINT) AS part, CASE WHEN n_nationkey < 20 THEN n_name ELSE 'NPC ' || c_nationkey END
        AS npc_name,
      CAST(coalesce(n_items, 0) AS INT) AS n_items, first_item, last_item
    FROM h LEFT JOIN n ON n.shop_id = h.shop_id AND n.part = h.part
      LEFT JOIN customer ON c_custkey = h.shop_id LEFT JOIN nation ON n_nationkey = c_nationkey
    """,
)
def _nested_shops_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A shop for each customer; those whose number no line item names as its supplier have no items."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("shop_id"), F.col("l_partkey").alias("item_id")
    )
    owners = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("shop_id"), F.col("c_nationkey").alias("npc_id")
    )
    nested = nest_children(
        owners, distinct_set(lines, ["shop_id"], "item_id"), ["shop_id"], "item_id", ["item_id"],
        "items", part_width=512,
    )
    names = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("npc_id"),
        F.when(F.col("n_nationkey") < 20, F.col("n_name")).alias("name"),
    )
    shops = with_npc_names(lookup_left(nested, owners, "shop_id", {"npc_id": "npc_id"}), names)
    return shops.select(
        "shop_id",
        "part",
        "npc_name",
        F.size("items").alias("n_items"),
        F.try_element_at("items", F.lit(1))["item_id"].alias("first_item"),
        F.try_element_at("items", F.lit(-1))["item_id"].alias("last_item"),
    )


@query(
    "sum_nested_sizes",
    "SELECT count(DISTINCT (l_suppkey, l_partkey)) AS total_items FROM lineitem",
)
def _sum_nested_sizes(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("shop_id"), F.col("l_partkey").alias("item_id")
    )
    items = distinct_set(lines, ["shop_id"], "item_id")
    nested = nest_children(None, items, ["shop_id"], "item_id", ["item_id"], "items")
    return sum_nested_sizes(nested, "items", "total_items")


@query(
    "first_nonempty_source",
    """
    WITH r AS (
      SELECT user_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS priority, event_id
      FROM events WHERE event_type IN ('purchase', 'click', 'view') AND value < 2),
    ok AS (SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'signup' AND value < 8)),
    n AS (SELECT user_id, priority, count(*) AS n_rows, min(event_id) AS first_event FROM r GROUP BY ALL),
    cand AS (SELECT user_id, 1 AS priority FROM ok UNION SELECT user_id, priority FROM n WHERE priority > 1),
    chosen AS (SELECT user_id, min(priority) AS priority FROM cand GROUP BY 1)
    SELECT chosen.user_id, CAST(chosen.priority AS INT) AS priority, coalesce(n_rows, 0) AS n_rows, first_event
    FROM chosen LEFT JOIN n ON n.user_id = chosen.user_id AND n.priority = chosen.priority
    """,
)
def _first_nonempty_source(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases of a user if that source worked (a cheap signup), else clicks, else views."""
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    priority = F.when(kind == "purchase", 1).when(kind == "click", 2).otherwise(3)
    rows = events.filter(kind.isin("purchase", "click", "view") & (F.col("value") < 2)).select(
        "user_id", priority.alias("priority"), "event_id"
    )
    # One scan gives the state of all three sources of a user.
    cheap = F.col("value") < 2
    state = events.groupBy("user_id").agg(
        (F.count_if((kind == "signup") & (F.col("value") < 8)) > 0).alias("ok"),
        *[F.count_if((kind == k) & cheap).alias(k) for k in ("purchase", "click", "view")],
    )
    status = state.select(
        "user_id",
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("priority"), "ok", F.col("purchase").alias("n_rows")),
                F.struct(F.lit(2).alias("priority"), F.lit(True).alias("ok"), F.col("click").alias("n_rows")),
                F.struct(F.lit(3).alias("priority"), F.lit(True).alias("ok"), F.col("view").alias("n_rows")),
            )
        ),
    )
    chosen, kept = first_nonempty_source(rows, status, ["user_id"])
    counts = kept.groupBy("user_id").agg(
        F.count("*").alias("n_rows"), F.min("event_id").alias("first_event")
    )
    return chosen.join(counts, "user_id", "left").select(
        "user_id", "priority", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first_event"
    )


@query(
    "shop_catalog",
    f"""WITH {SQL_OFFERS},
    smap AS (
      SELECT CAST(s_suppkey AS INT) AS shop, CAST(s_nationkey AS INT) AS npc, s_name AS shop_name,
        s_nationkey < 3 AS sampled, s_nationkey BETWEEN 3 AND 12 AS second, s_acctbal >= 2000 AS ok FROM supplier),
    defaults AS (
      SELECT CAST(p_partkey AS INT) AS item, coalesce(CASE WHEN p_type <> 'SMALL' THEN p_name END,
          CASE WHEN trim({SQL_INTERNAL}) <> '' THEN {SQL_INTERNAL} END, 'Item ' || p_partkey) AS name,
        CAST(round(p_retailprice) AS INT) AS price FROM part),
    lines AS (SELECT CAST(l_suppkey AS INT) AS shop, CAST(l_partkey AS INT) AS item, l_quantity AS q, l_returnflag AS f,
        l_discount AS d FROM lineitem),
    ids AS (
      SELECT shop, 2 AS priority, item FROM lines JOIN smap USING (shop) WHERE NOT sampled AND second AND q = 1 AND f = 'R'
      UNION SELECT shop, 3, item FROM lines JOIN smap USING (shop) WHERE NOT sampled AND q = 2
      UNION SELECT shop, 1, item FROM lines JOIN smap USING (shop) WHERE sampled AND q = 3 AND d < 0.02 AND item > 0
      UNION SELECT shop, 2, item FROM lines JOIN smap USING (shop) WHERE sampled AND q = 4 AND item BETWEEN 1000 AND 1500),
    alloffers AS (
      SELECT shop, 1 AS priority, item, name, price, conditions FROM offers JOIN smap USING (shop) WHERE NOT sampled AND ok
      UNION ALL
      SELECT ids.shop, priority, ids.item, name, price,
        CASE WHEN priority = 3 THEN coalesce(pl.conditions, '') ELSE '' END
      FROM ids LEFT JOIN defaults ON defaults.item = ids.item
        LEFT JOIN (SELECT shop, item, string_agg(cond, '&' ORDER BY o) AS conditions
          FROM (SELECT shop, item, cond, min(ord) AS o FROM parsed GROUP BY ALL) GROUP BY ALL) pl
          ON pl.shop = ids.shop AND pl.item = ids.item),
    cand AS (
      SELECT shop, priority FROM alloffers UNION SELECT shop, 1 FROM smap WHERE NOT sampled AND ok
      UNION SELECT shop, 9 FROM smap WHERE sampled),
    chosen AS (SELECT shop, min(priority) AS priority FROM cand GROUP BY 1),
    nested AS (
      SELECT shop, k // 64 AS part, count(*) AS n_items,
        string_agg(item || '|' || name || '|' || price || '|' || conditions, ';' ORDER BY item) AS items
      FROM (SELECT *, row_number() OVER (PARTITION BY shop ORDER BY item) - 1 AS k
        FROM alloffers JOIN chosen USING (shop, priority)) GROUP BY ALL),
    heads AS (SELECT shop, 0 AS part FROM chosen UNION SELECT shop, part FROM nested)
    SELECT shop AS shop_id, npc AS npc_id, CASE WHEN npc < 20 THEN n_name ELSE 'NPC ' || npc END AS npc_name, shop_name,
      CAST(part AS BIGINT) AS part, CAST(coalesce(n_items, 0) AS INT) AS n_items, coalesce(items, '') AS items
    FROM heads LEFT JOIN nested USING (shop, part) JOIN smap USING (shop) LEFT JOIN nation ON n_nationkey = npc
    """,
)
def _shop_catalog(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier")
    shop_map = supplier.select(
        F.col("s_suppkey").cast("int").alias("shop_id"),
        F.col("s_nationkey").cast("int").alias("npc_id"),
        F.col("s_name").alias("shop_name"),
        (F.col("s_nationkey") < 3).alias("sampled"),
        F.col("s_nationkey").between(3, 12).alias("has_second_source"),
    )
    runtime_ok = supplier.select(
        F.col("s_suppkey").cast("int").alias("shop_id"), (F.col("s_acctbal") >= 2000).alias("ok")
    )
    lines = table(spark, folder, "lineitem")
    ids = [F.col("l_suppkey").cast("int").alias("shop_id"), F.col("l_partkey").cast("int").alias("item_id")]
    rolls = lines.filter("l_quantity = 3 AND l_discount < 0.02").select(
        ids[0], F.col("l_linenumber").alias("sample"), F.col("l_partkey").cast("string").alias("item_id")
    )
    part = table(spark, folder, "part")
    item_defaults = part.select(
        F.col("p_partkey").cast("int").alias("item_id"),
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("ItemName."), "p_name"))
        .otherwise(F.col("p_name"))
        .alias("name"),
        F.round("p_retailprice").cast("int").alias("buy_price"),
    )
    npc_names = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("npc_id"),
        F.when(F.col("n_nationkey") < 20, F.col("n_name")).alias("name"),
    )
    shops = shop_catalog(
        shop_map=shop_map,
        slots=slots(spark, folder),
        runtime_ok=runtime_ok,
        parsed_items=lines.filter("l_quantity = 2").select(*ids).distinct(),
        conditions=conditions(spark, folder),
        second_items=lines.filter("l_quantity = 1 AND l_returnflag = 'R'").select(*ids).distinct(),
        rolls=rolls,
        constants=lines.filter("l_quantity = 4").select(*ids),
        item_defaults=item_defaults,
        internal_names=internal_names(spark, folder),
        npc_names=npc_names,
        id_count=1500,
        part_width=64,
    )
    return shops.select(
        "shop_id",
        "npc_id",
        "npc_name",
        "shop_name",
        "part",
        F.size("items").alias("n_items"),
        list_to_cell(F.transform("items", encode_offer)).alias("items"),
    )
