"""Data-quality checks on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions import contains_all, manifest_path, normalize_category
from stockloom.operators.checks import (
    RangeCheck,
    count_by_type,
    count_metrics,
    count_range,
    distinct_valid_ids,
    fk_violation_counts,
    fk_violations,
    fk_violations_nested,
    overall_status,
    row_counts,
    row_rules,
    section_result,
    spot_check,
    union_failures,
)
from stockloom.operators.dedupe import first_match
from stockloom.operators.nesting import nest_children
from stockloom.plans.validation import manifest_rules
from stockloom.queries.registry import query, table
from stockloom.sources.files import existing

_FK_FLAT = """
    SELECT 'orders' AS dataset, CAST(o_orderkey AS VARCHAR) AS record_id, 'o_orderkey' AS field,
      o_orderkey AS ref_id, CAST(NULL AS INT) AS element_index
    FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""


def orders_without_lines(spark: SparkSession, folder: str) -> DataFrame:
    return fk_violations(
        table(spark, folder, "orders"), F.col("o_orderkey"), table(spark, folder, "lineitem"),
        "l_orderkey", "orders", "o_orderkey", F.col("o_orderkey"), parent_unique=False,
    )


@query("fk_violations_flat", _FK_FLAT)
def _fk_violations_flat(spark: SparkSession, folder: str) -> DataFrame:
    return orders_without_lines(spark, folder)


@query(
    "fk_violation_counts",
    """
    SELECT l_partkey AS ref_id, count(*) AS n_rows FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY 1
    """,
)
def _fk_violation_counts(spark: SparkSession, folder: str) -> DataFrame:
    parents = table(spark, folder, "part").filter("p_size <= 40")
    return fk_violation_counts(table(spark, folder, "lineitem"), "l_partkey", parents, "p_partkey")


_FK_NESTED = """
    SELECT 'embeddings' AS dataset, CAST(vec_id AS VARCHAR) AS record_id,
      CASE WHEN ref_id IS NULL THEN 'ids[]' ELSE 'ids[].item_id' END AS field, ref_id, element_index
    FROM (SELECT vec_id, CASE WHEN CAST(x AS DOUBLE) < -0.3 THEN NULL
          ELSE CAST(round(CAST(x AS DOUBLE) * 100) AS BIGINT) END AS ref_id, element_index
      FROM (SELECT vec_id, unnest(embedding) AS x, CAST(unnest(range(len(embedding))) AS INT) AS element_index
        FROM embeddings))
    WHERE ref_id IS NULL OR ref_id NOT IN (SELECT n_nationkey FROM nation)"""


def dangling_elements(spark: SparkSession, folder: str) -> DataFrame:
    """An embedding is a list of references to nations; very negative values are no references."""
    ids = F.transform(
        "embedding",
        lambda x: F.when(
            x.cast("double") >= -0.3,
            F.struct(F.round(x.cast("double") * 100).cast("bigint").alias("item_id")),
        ),
    )
    lists = table(spark, folder, "embeddings").select("vec_id", ids.alias("ids"))
    return fk_violations_nested(
        lists, "ids", "item_id", table(spark, folder, "nation"), "n_nationkey", "embeddings",
        "ids[].item_id", F.col("vec_id"),
    )


@query("fk_violations_nested", _FK_NESTED)
def _fk_violations_nested(spark: SparkSession, folder: str) -> DataFrame:
    return dangling_elements(spark, folder)


_FK_CONDITIONAL = """
    SELECT 'events' AS dataset, CAST(event_id AS VARCHAR) AS record_id, 'user_id' AS field, user_id AS ref_id,
      CAST(NULL AS INT) AS element_index
    FROM events WHERE event_type = 'purchase' AND user_id > 0
      AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 0)"""


def purchases_without_account(spark: SparkSession, folder: str) -> DataFrame:
    category = normalize_category(F.concat(F.lit(" "), F.upper("event_type"), F.lit("\t")))
    return fk_violations(
        table(spark, folder, "events"), F.col("user_id"),
        table(spark, folder, "customer").filter("c_acctbal > 0"), "c_custkey", "events", "user_id",
        F.col("event_id"), exempt=(category != "purchase") | (F.col("user_id") <= 0),
    )


@query("fk_violations_conditional", _FK_CONDITIONAL)
def _fk_violations_conditional(spark: SparkSession, folder: str) -> DataFrame:
    return purchases_without_account(spark, folder)


@query(
    "union_failures",
    f"""
    SELECT dataset, field, section_rank, count(*) AS n_failures FROM (
      SELECT *, 0 AS section_rank FROM ({_FK_FLAT})
      UNION ALL SELECT *, 1 FROM ({_FK_NESTED})
      UNION ALL SELECT *, 2 FROM ({_FK_CONDITIONAL})) GROUP BY ALL
    """,
)
def _union_failures(spark: SparkSession, folder: str) -> DataFrame:
    failures = union_failures(
        orders_without_lines(spark, folder),
        dangling_elements(spark, folder),
        purchases_without_account(spark, folder),
    )
    return failures.groupBy("dataset", "field", "section_rank").agg(F.count("*").alias("n_failures"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(
    "row_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS metric, count(*) AS actual FROM {t}" for t in TABLES),
)
def _row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return row_counts({t: table(spark, folder, t) for t in TABLES})


@query(
    "count_by_type",
    """
    SELECT t AS type, CAST(count_if(event_type = t) AS BIGINT) AS n
    FROM events, (VALUES ('click'), ('view'), ('refund')) AS v(t) GROUP BY 1
    """,
)
def _count_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return count_by_type(table(spark, folder, "events"), F.trim("event_type"), ["click", "view", "refund"])


@query("distinct_valid_ids", "SELECT count(DISTINCT l_partkey) AS n_ids FROM lineitem")
def _distinct_valid_ids(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_valid_ids(table(spark, folder, "lineitem"), "l_partkey")


RANGES = [
    RangeCheck("lines", 1_000, 2_000_000_000),
    RangeCheck("returned_lines", 10, 100),
    RangeCheck("orders", 500_000_000_000),
    RangeCheck("urgent_orders", 1),
    RangeCheck("parts", 1, 10),
]
_SQL_RANGES = """
    WITH c AS (
      SELECT 'lines' AS name, count(*) AS actual, 1000 AS lo, 2000000000 AS hi FROM lineitem
      UNION ALL SELECT 'returned_lines', CAST(count_if(l_returnflag = 'R') AS BIGINT), 10, 100 FROM lineitem
      UNION ALL SELECT 'orders', count(*), 500000000000, NULL FROM orders
      UNION ALL SELECT 'urgent_orders', CAST(count_if(o_orderpriority = '1-URGENT') AS BIGINT), 1, NULL FROM orders
      UNION ALL SELECT 'parts', count(*), 1, 10 FROM part)
    SELECT name AS "check", CASE WHEN hi IS NULL THEN '>=' || lo ELSE lo || '-' || hi END AS expected, actual,
      actual >= lo AS pass, coalesce(actual > hi, false) AS warning,
      CASE WHEN actual < lo THEN 'FAIL' WHEN coalesce(actual > hi, false) THEN 'WARN' ELSE 'PASS' END AS status
    FROM c"""


def ranges(spark: SparkSession, folder: str) -> DataFrame:
    metrics = (
        count_metrics(
            table(spark, folder, "lineitem"),
            {"lines": None, "returned_lines": F.col("l_returnflag") == "R"},
        )
        .unionByName(
            count_metrics(
                table(spark, folder, "orders"),
                {"orders": None, "urgent_orders": F.col("o_orderpriority") == "1-URGENT"},
            )
        )
        .unionByName(count_metrics(table(spark, folder, "part"), {"parts": None}))
    )
    return count_range(metrics, RANGES)


@query("count_ranges", _SQL_RANGES)
def _count_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return ranges(spark, folder)


_SQL_RULES = """
    WITH m AS (
      SELECT CAST(p_partkey AS INT) - 5 AS id,
        CASE p_type WHEN 'SMALL' THEN ' ITEM' WHEN 'LARGE' THEN 'boss' WHEN 'PROMO' THEN NULL WHEN 'MEDIUM' THEN 'npc'
          ELSE 'item' END AS category,
        p_size - 3 AS width, CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_size - 2 END AS height,
        CASE WHEN p_brand = 'Brand#2' THEN '  ' WHEN p_brand = 'Brand#3' THEN '\\sprites\\items/' || p_partkey || '.png'
          ELSE 'sprites/npcs/' || p_partkey || '.png' END AS path, p_partkey FROM part),
    n AS (SELECT *, lower(trim(coalesce(category, ''))) AS cat, ltrim(replace(path, '\\', '/'), '/') AS norm,
      trim(path) = '' AS blank FROM m)
    SELECT CAST(p_partkey AS BIGINT) AS record_id, 'id' AS field, 'id must be a non-negative integer' AS error,
      CAST(id AS VARCHAR) AS value FROM n WHERE id < 0
    UNION ALL SELECT p_partkey, 'category', 'category must be ''item'' or ''npc''', category FROM n WHERE cat NOT IN ('item', 'npc')
    UNION ALL SELECT p_partkey, 'width', 'width must be a positive integer', CAST(width AS VARCHAR) FROM n WHERE width <= 0
    UNION ALL SELECT p_partkey, 'height', 'height must be a positive integer', CAST(height AS VARCHAR) FROM n
      WHERE coalesce(height, 0) <= 0
    UNION ALL SELECT p_partkey, 'spriteFile', 'spriteFile must be a non-empty string', path FROM n WHERE blank
    UNION ALL SELECT p_partkey, 'spriteFile', 'spriteFile must start with ''sprites/' || cat || 's/'' for category ''' || cat || '''',
      path FROM n WHERE NOT blank AND cat IN ('item', 'npc') AND NOT starts_with(norm, 'sprites/' || cat || 's/')
    """.replace("\\\\", "\\")


def rule_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rules over parts with damage by type, brand and size."""
    kind, brand, key = F.col("p_type"), F.col("p_brand"), F.col("p_partkey")
    name = F.concat(key.cast("string"), F.lit(".png"))
    rows = table(spark, folder, "part").select(
        "p_partkey",
        (key.cast("int") - 5).alias("id"),
        F.when(kind == "SMALL", " ITEM")
        .when(kind == "LARGE", "boss")
        .when(kind == "PROMO", F.lit(None))
        .when(kind == "MEDIUM", "npc")
        .otherwise("item")
        .alias("category"),
        F.when(brand == "Brand#2", "  ")
        .when(brand == "Brand#3", F.concat(F.lit("\\sprites\\items/"), name))
        .otherwise(manifest_path("npcs", key.cast("string")))
        .alias("sprite_file"),
        (F.col("p_size") - 3).alias("width"),
        F.when(brand != "Brand#1", F.col("p_size") - 2).alias("height"),
    )
    return row_rules(rows, F.col("p_partkey"), manifest_rules())


@query("row_rules", _SQL_RULES)
def _row_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rule_failures(spark, folder)


@query(
    "required_tables",
    "SELECT 'archive.parquet' AS file, false AS \"exists\", CAST(NULL AS BIGINT) AS n_rows UNION ALL "
    + " UNION ALL ".join(f"SELECT '{t}.parquet', true, count(*) FROM {t}" for t in TABLES),
)
def _required_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Expected tables, single files or folders of part files, with the rows of each."""
    present = existing(spark, folder, [f"{t}.parquet" for t in (*TABLES, "archive")])
    counts = row_counts({f"{t}.parquet": table(spark, folder, t) for t in TABLES})
    return present.join(counts, present["file"] == counts["metric"], "left").select(
        "file", "exists", F.col("actual").alias("n_rows")
    )


_SQL_SPOTS = """
    WITH words AS (SELECT min(doc_id) AS doc_id FROM documents
      WHERE list_has_all(string_split(text, ' '), ['the', 'and', 'of'])),
    offer AS (SELECT min((l_orderkey, l_linenumber, l_partkey)) AS r FROM lineitem WHERE l_suppkey = 17 AND l_quantity = 8),
    edge AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_custkey = 8 AND o_orderstatus = 'X'),
    open_edge AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O'),
    nested AS (SELECT min(l_suppkey) AS k FROM lineitem WHERE l_partkey = 8)
    SELECT 'words_present' AS "check", doc_id IS NOT NULL AS pass, '{"doc_id":' || doc_id || '}' AS evidence,
      'the, and, of' AS required FROM words
    UNION ALL SELECT 'offer_present', r IS NOT NULL, '{"l_orderkey":' || r[1] || ',"l_linenumber":' || r[2] || ',"l_partkey":' || r[3] || '}',
      'supplier 17 with quantity 8' FROM offer
    UNION ALL SELECT 'order_present', k IS NOT NULL, CAST(k AS VARCHAR), 'customer 8 with status X' FROM edge
    UNION ALL SELECT 'open_order_present', k IS NOT NULL, '{"o_orderkey":' || k || '}', 'an order with status O' FROM open_edge
    UNION ALL SELECT 'nested_offer_present', k IS NOT NULL, '{"supplier":' || k || ',"n_items":1}', 'a supplier of part 8' FROM nested"""


def spots(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", F.split("text", " ").alias("words"))
    wanted = documents.filter(contains_all(F.col("words"), ["the", "and", "of"])).select("doc_id")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    offer = first_match(
        lines,
        (F.col("l_suppkey") == 17) & (F.col("l_quantity") == 8),
        ["l_orderkey", "l_linenumber", "l_partkey"],
    ).select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    order = first_match(
        orders, (F.col("o_custkey") == 8) & (F.col("o_orderstatus") == "X"), ["o_orderkey"]
    )
    opened = first_match(orders, F.col("o_orderstatus") == "O", ["o_orderkey"]).select("o_orderkey")
    offers = lines.select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("item_id")).distinct()
    shops = nest_children(None, offers, ["supplier"], "item_id", ["item_id"], "items")
    hits = F.filter("items", lambda x: x["item_id"] == 8)
    nested = first_match(shops, F.size(hits) > 0, ["supplier"]).select("supplier", F.size(hits).alias("n_items"))
    return (
        spot_check("words_present", first_match(wanted, F.lit(True), ["doc_id"]), "the, and, of")
        .unionByName(spot_check("offer_present", offer, "supplier 17 with quantity 8"))
        .unionByName(spot_check("order_present", order, "customer 8 with status X"))
        .unionByName(spot_check("open_order_present", opened, "an order with status O"))
        .unionByName(spot_check("nested_offer_present", nested, "a supplier of part 8"))
    )


@query("spot_checks", _SQL_SPOTS)
def _spot_checks(spark: SparkSession, folder: str) -> DataFrame:
    return spots(spark, folder)


_SQL_SECTIONS = f"""
    SELECT 'count_ranges' AS section, CAST(count_if(NOT pass) AS BIGINT) AS n_failures FROM ({_SQL_RANGES})
    UNION ALL SELECT 'foreign_keys', count(*) FROM ({_FK_FLAT})
    UNION ALL SELECT 'row_rules', count(*) FROM ({_SQL_RULES})
    UNION ALL SELECT 'spot_checks', CAST(count_if(NOT pass) AS BIGINT) FROM ({_SQL_SPOTS})
    UNION ALL SELECT 'lines_have_orders', count(*) FROM lineitem
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)"""


def sections(spark: SparkSession, folder: str) -> DataFrame:
    lines_without_order = fk_violations(
        table(spark, folder, "lineitem"), F.col("l_orderkey"), table(spark, folder, "orders"),
        "o_orderkey", "lineitem", "l_orderkey", F.col("l_orderkey"),
    )
    return (
        section_result("count_ranges", ranges(spark, folder).filter(~F.col("pass")))
        .unionByName(section_result("foreign_keys", orders_without_lines(spark, folder)))
        .unionByName(section_result("row_rules", rule_failures(spark, folder)))
        .unionByName(section_result("spot_checks", spots(spark, folder).filter(~F.col("pass"))))
        .unionByName(section_result("lines_have_orders", lines_without_order))
    )


@query(
    "validation_sections",
    f"SELECT section, n_failures, n_failures = 0 AS pass FROM ({_SQL_SECTIONS})",
)
def _validation_sections(spark: SparkSession, folder: str) -> DataFrame:
    return sections(spark, folder)


@query(
    "validation_status",
    f"""SELECT CASE WHEN bool_and(n_failures = 0) THEN 'PASS' ELSE 'FAIL' END AS status,
      CAST(count_if(n_failures = 0) AS BIGINT) AS n_passed, CAST(count_if(n_failures > 0) AS BIGINT) AS n_failed FROM ({_SQL_SECTIONS})""",
)
def _validation_status(spark: SparkSession, folder: str) -> DataFrame:
    return overall_status(sections(spark, folder))


@query(
    "validation_status_pass",
    """SELECT 'PASS' AS status, CAST(2 AS BIGINT) AS n_passed, CAST(0 AS BIGINT) AS n_failed
      WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL) = 0 AND (SELECT count(*) FROM orders) > 0""",
)
def _validation_status_pass(spark: SparkSession, folder: str) -> DataFrame:
    """Sections without failures: every order is an order, and there is one with status O or another."""
    orders = table(spark, folder, "orders")
    known = fk_violations(orders, F.col("o_orderkey"), orders, "o_orderkey", "orders", "o_orderkey", F.col("o_orderkey"))
    enough = count_range(row_counts({"orders": orders}), [RangeCheck("orders", 1)])
    return overall_status(
        section_result("known_orders", known).unionByName(section_result("count_ranges", enough.filter(~F.col("pass"))))
    )
