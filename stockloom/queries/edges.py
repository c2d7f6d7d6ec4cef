"""Transformation edges over parts (items) and orders (recipes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.operators.edges import (
    decompose_edges,
    direct_edges,
    edge_names,
    edge_order,
    flat_recipe_outputs,
    recipe_outputs,
    transform_edges,
)
from stockloom.queries.catalog import LINE_ORDER, SQL_INTERNAL, SQL_LOCALIZED, part_names
from stockloom.operators.scans import with_position
from stockloom.queries.registry import query, table


def names(spark: SparkSession, folder: str) -> DataFrame:
    return edge_names(part_names(spark, folder))


def transform_map(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("int"), F.col("p_size")
    return table(spark, folder, "part").select(
        key.alias("item_id"),
        F.when(size <= 5, key + size).when(size <= 10, -1).otherwise(0).alias("to_item_id"),
    )


def equivalence_map(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("int"), F.col("p_size")
    return table(spark, folder, "part").filter("p_type <> 'STANDARD'").select(
        key.alias("item_id"),
        F.when(F.col("p_type") == "PROMO", key - size).otherwise(0).alias("counts_as_id"),
    )


def decraft_map(spark: SparkSession, folder: str) -> DataFrame:
    """Each part's first order, or -1 for a part never ordered in a quantity of 50."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.col("l_partkey").cast("int").alias("item_id")).agg(
        F.when(F.max("l_quantity") < 50, -1)
        .otherwise(F.min("l_orderkey").cast("int"))
        .alias("recipe_index")
    )


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs of the recipes that any part points to."""
    wanted = decraft_map(spark, folder).select("recipe_index").distinct()
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("int").alias("recipe_index"),
        *LINE_ORDER,
        F.when(F.col("l_quantity") > 45, 0)
        .otherwise(F.col("l_partkey"))
        .cast("int")
        .alias("type"),
        (F.col("l_quantity") - 25).cast("int").alias("stack"),
    )
    orders = table(spark, folder, "orders").filter("o_orderpriority IN ('1-URGENT', '2-HIGH')")
    has_custom = orders.select(F.col("o_orderkey").cast("int").alias("recipe_index"))
    # Urgent orders have an empty custom list; high ones have one custom result.
    custom = orders.filter("o_orderpriority = '2-HIGH'").select(
        F.col("o_orderkey").cast("int").alias("recipe_index"),
        F.lit(0).alias("l_linenumber"),
        F.lit(0).cast("bigint").alias("l_partkey"),
        F.lit(0).cast("bigint").alias("l_suppkey"),
        F.lit(0.0).alias("l_quantity"),
        F.lit(0.0).alias("l_extendedprice"),
        F.col("o_custkey").cast("int").alias("type"),
        F.lit(0).alias("stack"),
    )
    required = lines.join(wanted, "recipe_index", "left_semi")
    return flat_recipe_outputs(required, custom, has_custom, LINE_ORDER)


SQL_EDGES = f"""
    names AS (
      SELECT CAST(p_partkey AS INT) AS id, coalesce(
        CASE WHEN trim({SQL_LOCALIZED}) <> '' THEN {SQL_LOCALIZED} END,
        CASE WHEN trim({SQL_INTERNAL}) <> '' THEN {SQL_INTERNAL} END, 'Item_' || p_partkey) AS name FROM part),
    tmap AS (
      SELECT CAST(p_partkey AS INT) AS item_id, CASE WHEN p_size <= 5 THEN CAST(p_partkey AS INT) + p_size
        WHEN p_size <= 10 THEN -1 ELSE 0 END AS to_item_id FROM part),
    equiv AS (
      SELECT CAST(p_partkey AS INT) AS id,
        CASE WHEN p_type = 'PROMO' AND p_partkey - p_size > 0 THEN CAST(p_partkey AS INT) - p_size
          ELSE CAST(p_partkey AS INT) END AS eq
      FROM part WHERE p_partkey >= 1),
    decraft AS (
      SELECT CAST(l_partkey AS INT) AS item_id, CASE WHEN max(l_quantity) < 50 THEN -1
        ELSE CAST(min(l_orderkey) AS INT) END AS recipe_index FROM lineitem GROUP BY 1),
    slots AS (
      SELECT CAST(l_orderkey AS INT) AS recipe_index, l_linenumber AS a, l_partkey AS b, l_suppkey AS c,
        l_quantity AS d, l_extendedprice AS e,
        CAST(CASE WHEN l_quantity > 45 THEN 0 ELSE l_partkey END AS INT) AS type,
        CAST(l_quantity - 25 AS INT) AS stack
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
      UNION ALL
      SELECT CAST(o_orderkey AS INT), 0, 0, 0, 0, 0, CAST(o_custkey AS INT), 0 FROM orders
      WHERE o_orderpriority = '2-HIGH'),
    outs AS (
      SELECT recipe_index, type, CASE WHEN stack <= 0 THEN 1 ELSE stack END AS amount
      FROM (SELECT *, bool_or(type <= 0) OVER (PARTITION BY recipe_index ORDER BY a, b, c, d, e
              RANGE UNBOUNDED PRECEDING) AS stopped FROM slots)
      WHERE NOT stopped),
    direct AS (
      SELECT item_id AS i, to_item_id AS o, 1 AS amount, 'item_transform' AS type FROM tmap
      WHERE item_id >= 1 AND to_item_id > 0),
    decomposed AS (
      SELECT DISTINCT equiv.id AS i, outs.type AS o, outs.amount, 'deconstruct' AS type
      FROM equiv JOIN decraft ON decraft.item_id = equiv.eq AND decraft.recipe_index >= 0
        JOIN outs ON outs.recipe_index = decraft.recipe_index
      WHERE equiv.eq NOT IN (SELECT item_id FROM tmap WHERE to_item_id > 0))"""


def _sql(source: str) -> str:
    return f"""WITH {SQL_EDGES}
    SELECT i AS input_item_id, coalesce(a.name, 'Item_' || i) AS input_item_name, o AS output_item_id,
      coalesce(b.name, 'Item_' || o) AS output_item_name, amount AS output_amount, type
    FROM {source} LEFT JOIN names a ON a.id = i LEFT JOIN names b ON b.id = o"""


BOTH = "(SELECT * FROM direct UNION ALL SELECT * FROM decomposed)"


@query("direct_edges", _sql("direct"))
def _direct_edges(spark: SparkSession, folder: str) -> DataFrame:
    return direct_edges(names(spark, folder), transform_map(spark, folder))


@query("decompose_edges", _sql("decomposed"))
def _decompose_edges(spark: SparkSession, folder: str) -> DataFrame:
    return decompose_edges(
        names(spark, folder),
        transform_map(spark, folder),
        equivalence_map(spark, folder),
        decraft_map(spark, folder),
        outputs(spark, folder),
    )


def all_edges(spark: SparkSession, folder: str) -> DataFrame:
    return transform_edges(
        names(spark, folder),
        transform_map(spark, folder),
        equivalence_map(spark, folder),
        decraft_map(spark, folder),
        outputs(spark, folder),
    )


@query("transform_edges", _sql(BOTH))
def _transform_edges(spark: SparkSession, folder: str) -> DataFrame:
    return all_edges(spark, folder)


@query(
    "edge_order",
    f"""SELECT *, row_number() OVER (ORDER BY input_item_id, type, output_item_id, output_amount) - 1 AS position
    FROM ({_sql(BOTH)})""",
)
def _edge_order(spark: SparkSession, folder: str) -> DataFrame:
    """All edges with their place in the order."""
    return with_position(edge_order(all_edges(spark, folder)))


@query(
    "nested_recipe_outputs",
    """
    WITH t AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100) AS INT) + 12) AS ids
      FROM embeddings),
    c AS (SELECT vec_id, CASE WHEN label = 0 THEN [] ELSE ids END AS ids FROM t),
    s AS (SELECT vec_id, CASE WHEN coalesce(list_position(list_transform(ids, lambda x: x <= 0), true), 0) = 0 THEN ids
      ELSE ids[1:list_position(list_transform(ids, lambda x: x <= 0), true) - 1] END AS kept FROM c)
    SELECT vec_id AS recipe_index, output_item_id, count(*) AS n
    FROM (SELECT vec_id, unnest(kept) AS output_item_id FROM s) GROUP BY ALL
    """,
)
def _nested_recipe_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """The nested form on native arrays: an embedding is a list of output ids."""
    ids = F.transform(
        "embedding",
        lambda x: F.struct(
            (F.round(x.cast("double") * 100).cast("int") + 12).alias("type"), F.lit(1).alias("stack")
        ),
    )
    recipes = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("recipe_index"),
        ids.alias("required_items"),
        F.when(F.col("label") == 0, F.slice(ids, 1, 0)).alias("custom_results"),
    )
    return recipe_outputs(recipes).groupBy("recipe_index", "output_item_id").agg(
        F.count("*").alias("n")
    )
