"""Scoped text: line items written out as brace-structured source and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.operators.scoped_text import match_all, scoped_extract
from stockloom.queries.registry import query, table

LINES_PER_GROUP = 16


def source_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line_no, line): one file per return flag, so each file holds a third of all lines.

    Every (order, line number) becomes a case section with an outer condition, an inner condition
    and an else branch; all its parts stand in it, those of one line number (a key of the order) on one line.
    """
    part = F.col("l_partkey").cast("string")
    items = table(spark, folder, "lineitem")
    groups = (
        items.groupBy("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("file"))
        .agg(
            F.min("l_partkey").cast("string").alias("low"),
            F.array_join(
                F.sort_array(F.collect_set(F.concat(F.lit("y.SetDefaults("), part, F.lit(");")))), " "
            ).alias("all"),
            F.max("l_quantity").cast("int").cast("string").alias("quantity"),
            F.max("l_linestatus").alias("status"),
        )
    )

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    case = (F.col("l_orderkey") + 1).cast("string")
    body = F.array(
        text("    case ", case, ":"),
        text("if (Main.LocalPlayer.quantity   > ", F.col("quantity"), ")"),
        F.lit("{"),
        text("x.SetDefaults(", F.col("low"), ");"),
        text("if (status(", F.col("status"), ")) {"),
        F.col("all"),
        F.lit("}"),
        F.lit("}"),
        F.lit("else"),
        F.lit("{"),
        text("w.SetDefaults(9", F.col("low"), ");"),
        F.lit("}"),
    )
    base = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * LINES_PER_GROUP + 2).cast("bigint")
    lines = groups.select("file", base.alias("base"), F.posexplode(body).alias("k", "line")).select(
        "file", (F.col("base") + F.col("k")).alias("line_no"), "line"
    )
    # The header stays on the first two lines, the footer after every section.
    ends = items.groupBy(F.col("l_returnflag").alias("file")).agg((F.max("l_orderkey") * 8 + 16).alias("last"))
    frame = F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit("public void SetupShop(int type) {").alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit("switch (type) {").alias("line")),
        F.struct((F.col("last") * LINES_PER_GROUP).alias("line_no"), F.lit("} }").alias("line")),
    )
    return lines.unionByName(ends.select("file", F.inline(frame)))


@query(
    "scoped_extract",
    """
    WITH g AS (
      SELECT l_returnflag AS file, l_orderkey, l_linenumber, CAST(min(l_partkey) AS VARCHAR) AS low,
        list(DISTINCT CAST(l_partkey AS VARCHAR)) AS parts, CAST(CAST(max(l_quantity) AS INT) AS VARCHAR) AS q,
        max(l_linestatus) AS s
      FROM lineitem GROUP BY ALL),
    i AS (
      SELECT file, l_orderkey, l_linenumber, 0 AS k, low AS item, ['player.quantity > ' || q] AS conds FROM g
      UNION ALL SELECT file, l_orderkey, l_linenumber, 1, unnest(parts), ['player.quantity > ' || q, 'status(' || s || ')'] FROM g
      UNION ALL SELECT file, l_orderkey, l_linenumber, 3, '9' || low, [] FROM g),
    items AS (SELECT DISTINCT file, l_orderkey, item FROM i),
    c AS (SELECT file, l_orderkey, l_linenumber, k, item, unnest(conds) AS cond, unnest(range(len(conds))) AS ord FROM i),
    f AS (SELECT file, l_orderkey, item, cond, min((l_linenumber, k, ord)) AS place FROM c GROUP BY ALL),
    l AS (SELECT file, l_orderkey, item, string_agg(cond, ' & ' ORDER BY place) AS conditions FROM f GROUP BY ALL)
    SELECT file, CAST(l_orderkey + 1 AS INT) AS case_id, CAST(item AS INT) AS item_id, coalesce(conditions, '') AS conditions
    FROM items LEFT JOIN l USING (file, l_orderkey, item)
    """,
)
def _scoped_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = scoped_extract(source_lines(spark, folder))
    return found.select(
        "file", "case_id", "item_id", F.array_join("conditions", " & ").alias("conditions")
    )


@query(
    "text_lines",
    r"""
    WITH l AS (
      SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) + 1 AS line_no
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
    SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(length(line) AS INT) AS n_chars,
      array_to_string(regexp_extract_all(line, '([0-9]+)'), ',') AS numbers
    FROM l
    """,
)
def _text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document with all numbers in each."""
    lines = table(spark, folder, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    return lines.select(
        "doc_id",
        (F.col("pos") + 1).alias("line_no"),
        F.length("line").alias("n_chars"),
        F.array_join(match_all(F.col("line"), "([0-9]+)"), ",").alias("numbers"),
    )
