from pyspark.sql import functions as F

from stockloom.functions import (
    contains_all,
    default_amount,
    display_name,
    encode_ingredient,
    encode_offer,
    equivalent_id,
    flags_to_labels,
    is_plausible_id,
    lenient_bool,
    lenient_int,
    list_to_cell,
    nested_size,
    normalize_category,
    normalize_condition,
    normalize_path,
    parse_numeric_id,
    sell_price,
    special_currency_label,
    take_while,
)


def values(df):
    return [r[0] for r in df.collect()]


def test_integer_division_truncates(spark):
    df = spark.createDataFrame([(7,), (-7,), (4,)], "v int").coalesce(1)
    assert values(df.select(sell_price(F.col("v")))) == [1, -1, 0]


def test_display_name(spark):
    data = [("",), ("ItemName.X",), ("itemname.X",), ("Torch",), (None,), (" 　",)]
    df = spark.createDataFrame(data, "n string").coalesce(1)
    got = values(df.select(display_name(F.col("n"), F.lit("int"))))
    assert got == ["int", "int", "itemname.X", "Torch", "int", "int"]
    assert values(df.limit(1).select(display_name(F.col("n"), F.lit(None).cast("string")))) == [""]


def test_take_while(spark):
    df = spark.sql(
        "select array(named_struct('type',23),null,named_struct('type',9),named_struct('type',0),"
        "named_struct('type',5)) a, array(0,18,-1,7) b, array(3,null,4) c,"
        " cast(null as array<int>) d, array(-1) e"
    )
    row = df.select(
        take_while(F.col("a"), lambda x: x["type"] <= 0).alias("a"),
        take_while(F.col("b"), lambda x: F.coalesce(x, F.lit(0)) < 0, skip_null=False).alias("b"),
        take_while(F.col("c"), lambda x: x < 0, skip_null=False).alias("c"),
        take_while(F.col("d"), lambda x: x < 0).alias("d"),
        take_while(F.col("e"), lambda x: x < 0).alias("e"),
        nested_size(F.col("d")).alias("n"),
    ).head()
    assert [x["type"] for x in row["a"]] == [23, 9]
    assert (row["b"], row["c"], row["d"], row["e"], row["n"]) == ([0, 18], [3, None, 4], [], [], 0)


def test_labels_and_containment(spark):
    flags = [(F.lit(True), "Water"), (F.lit(False), "Lava"), (F.lit(None).cast("boolean"), "Honey"), (F.lit(True), "CrimsonWorld")]
    df = spark.range(1)
    assert values(df.select(flags_to_labels(flags))) == [["Water", "CrimsonWorld"]]
    ids = F.array(F.lit(9), F.lit(23), F.lit(1))
    assert values(df.select(contains_all(ids, [9, 23]))) == [True]
    assert values(df.select(contains_all(ids, [9, 24]))) == [False]
    assert values(df.select(contains_all(F.array(F.lit(9), F.lit(None).cast("int")), [9, 24]))) == [False]


def test_encoding(spark):
    df = spark.sql(
        "select named_struct('item_id',23,'name','Gel','count',1) i,"
        " named_struct('item_id',8,'name','Torch','buy_price',50,'conditions',array()) o,"
        " named_struct('item_id',8,'name',null,'buy_price',50,'conditions',array('a','b')) p,"
        " array('x',null,'y') l"
    )
    row = df.select(
        encode_ingredient(F.col("i")), encode_offer(F.col("o")), encode_offer(F.col("p")), list_to_cell(F.col("l"))
    ).head()
    assert list(row) == ["23:Gelx1", "8|Torch|50|", "8||50|a&b", "x;;y"]


def test_ids(spark):
    names = ["Item_8.xnb", "item_08.XNB", "Item_x.xnb", "Item_-1.xnb", "Item_99999999999.xnb", "Item_.xnb", "NPC_1.xnb"]
    df = spark.createDataFrame([(n,) for n in names], "f string").coalesce(1)
    assert values(df.select(parse_numeric_id(F.col("f"), "Item_"))) == [8, 8, None, None, None, None, None]
    pairs = spark.createDataFrame([(5, 7), (5, 0), (5, -1), (5, None)], "i int, m int").coalesce(1)
    assert values(pairs.select(equivalent_id(F.col("i"), F.col("m")))) == [7, 5, 5, 5]
    plausible = spark.createDataFrame([(999,), (1000,), (1500,), (1501,)], "i int").coalesce(1)
    assert values(plausible.select(is_plausible_id(F.col("i"), F.lit(1500)))) == [False, True, True, False]
    amounts = spark.createDataFrame([(0,), (-3,), (2,)], "a int").coalesce(1)
    assert values(amounts.select(default_amount(F.col("a")))) == [1, 1, 2]


def test_text(spark):
    data = [("  Main.LocalPlayer.zone \t &&  x ", " ITEM\u001f", "\\/a\\b"), (None, None, None), ("  ", "npc", "/x")]
    df = spark.createDataFrame(data, "a string, b string, c string").coalesce(1)
    assert values(df.select(normalize_condition(F.col("a")))) == ["player.zone && x", "", ""]
    assert values(df.select(normalize_category(F.col("b")))) == ["item", "", "npc"]
    assert values(df.select(normalize_path(F.col("c")))) == ["a/b", None, "x"]
    currency = spark.createDataFrame([(0,), (-1,)], "c int").coalesce(1)
    assert values(currency.select(special_currency_label(F.col("c")))) == ["specialCurrency=0", None]


def test_lenient_parsing(spark):
    df = spark.createDataFrame([("7",), ("x",), (None,), ("99999999999",)], "r string").coalesce(1)
    assert values(df.select(lenient_int(F.col("r")))) == [7, 0, 0, 0]
    flags = spark.createDataFrame([("True",), (" true ",), ("1",), (None,)], "r string").coalesce(1)
    assert values(flags.select(lenient_bool(F.col("r")))) == [True, True, False, False]
