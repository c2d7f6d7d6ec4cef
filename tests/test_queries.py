"""Every registered query against its SQL, on the smallest test set and on a skewed one."""

import os
import tempfile

import duckdb
import pytest

from stockloom.queries import ORACLES, QUERIES
from tools.check_queries import canonical

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def connect(folder):
    db = duckdb.connect()
    for file in os.listdir(folder):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return db


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def skewed():
    """The same tables with a third of all line items on one order, part and supplier."""
    out = tempfile.mkdtemp(prefix="spark-")
    source = connect(FOLDER)
    for file in os.listdir(FOLDER):
        name = file.split(".")[0]
        hot = "l_linenumber % 3 = 0"
        columns = (
            f"* REPLACE (CASE WHEN {hot} THEN 7 ELSE l_orderkey END AS l_orderkey,"
            f" CASE WHEN {hot} AND l_quantity > 25 THEN 7 ELSE l_partkey END AS l_partkey,"
            f" CASE WHEN {hot} THEN 7 ELSE l_suppkey END AS l_suppkey)"
            if name == "lineitem"
            else "*"
        )
        source.execute(f"COPY (SELECT {columns} FROM {name}) TO '{out}/{file}' (FORMAT parquet)")
    return out


def compare(spark, folder, db, name):
    got = QUERIES[name](spark, folder).toPandas()
    wanted = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert canonical(got) == canonical(wanted)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    compare(spark, FOLDER, db, name)


@pytest.mark.parametrize(
    "name",
    ["decompose_edges", "encode_cells", "recipe_projection", "shop_catalog", "shop_items", "take_while_rows"],
)
def test_skewed_query_matches_sql(spark, skewed, name):
    compare(spark, skewed, connect(skewed), name)


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


def test_partition_count_does_not_matter(spark, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows(QUERIES["shop_items"](spark, FOLDER)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
