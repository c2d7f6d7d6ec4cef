import itertools
import random

import pytest
from pyspark.sql import functions as F

from stockloom.operators import checks, edges, scans, shops
from stockloom.operators.assets import asset_header, asset_manifest, manifest_order
from stockloom.operators.dedupe import dedupe_first, first_match, first_nonempty_source
from stockloom.operators.lookups import first_wins_map
from stockloom.operators.checks import contains_all_rows
from stockloom.operators.nesting import distinct_over_samples, nest_children, take_while_rows
from stockloom.operators.scans import RunningLast, RunningSum, running
from stockloom.sources.files import assets_of


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_running_values_match_a_plain_loop(spark, block):
    rng = random.Random(3)
    data = []
    for key in "ab":
        for pos in sorted(rng.sample(range(200), 60)):
            data.append((key, pos, rng.choice([None, 1, 5, -2]), rng.choice([None, None, "x", "y"])))
    df = spark.createDataFrame(data, "k string, pos int, v int, t string")
    specs = [
        RunningSum("s", F.col("v")),
        RunningSum("s_before", F.col("v"), inclusive=False),
        RunningLast("l", F.col("t")),
        RunningLast("l_before", F.col("t"), inclusive=False),
    ]
    got = {(r["k"], r["pos"]): tuple(r)[4:] for r in running(df, ["k"], ["pos"], specs, F.floor(F.col("pos") / block)).collect()}
    for key in "ab":
        total, last = 0, None
        for _, pos, v, t in (r for r in data if r[0] == key):
            before = (total, last)
            total, last = total + (v or 0), t or last
            assert got[(key, pos)] == (total, before[0], last, before[1])


def test_groups_of_one_block_are_given_nothing(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(scans, "materialize", lambda df: stored.append(df) or df)
    df = spark.createDataFrame([(k, p) for k in "abc" for p in range(5)] + [("c", 12), (None, 3), (None, 13)], "k string, p int")
    out = running(df, ["k"], ["p"], [RunningSum("n", F.lit(1))], F.floor(F.col("p") / 10))
    got = {(r["k"], r["p"]): r["n"] for r in out.collect()}
    assert len(got) == 18 and got[("a", 4)] == 5 and got[("c", 12)] == 6 and got[(None, 13)] == 2
    assert stored[-1].count() == 2


def test_dedupe_and_first_wins(spark, rows):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 5)], "k int, v string, pos int")
    assert rows(dedupe_first(df, ["k"], ["pos"])) == [(1, "a", 1), (2, "c", 5)]
    names = spark.createDataFrame([(1, None, 1), (1, "x", 2), (0, "z", 0), (-1, "z", 0)], "id int, n string, pos int")
    assert rows(first_wins_map(names, "id", "n", ["pos"])) == [(1, "")]
    assert rows(first_match(df, F.col("k") == 1, ["pos"])) == [(1, "a", 1)]
    assert rows(first_match(df, F.col("k") == 9, ["pos"])) == []


def test_take_while_rows_equals_a_loop(spark, rows):
    rng = random.Random(5)
    data = [(k, p, rng.choice([None, 1, 2, 0])) for k in range(20) for p in range(rng.randint(1, 9))]
    df = spark.createDataFrame(data, "k int, p int, v int")
    wanted = []
    for _, group in itertools.groupby(data, key=lambda r: r[0]):
        wanted += list(itertools.takewhile(lambda r: r[2] is None or r[2] > 0, group))
    assert rows(take_while_rows(df, ["k"], ["p"], F.col("v") <= 0)) == sorted(wanted, key=repr)


def test_nested_lists_stay_whole_and_bounded(spark, rows):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "s int")
    children = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 17)], "s int, item int")
    nested = nest_children(parents, children, ["s"], "item", ["item"], "items", part_width=10)
    got = {(r["s"], r["part"]): [x["item"] for x in r["items"]] for r in nested.collect()}
    assert got == {
        (1, 0): list(range(10)), (1, 1): list(range(10, 20)), (1, 2): list(range(20, 25)),
        (2, 0): [17], (3, 0): [],
    }
    # Parts depend on the number of children, not on their ids; nothing is rounded.
    far = spark.createDataFrame(
        [(1, 9), (1, 70_000), (1, -(1 << 62)), (2, 2**53 + 1), (2, 2**53), (None, 5)], "s int, item bigint"
    )
    nested = nest_children(None, far, ["s"], "item", ["item"], "items", part_width=2)
    got = {(r["s"], r["part"]): [x["item"] for x in r["items"]] for r in nested.collect()}
    assert got == {(1, 0): [-(1 << 62), 9], (1, 1): [70_000], (2, 0): [2**53, 2**53 + 1], (None, 0): [5]}


def test_contains_all_rows_of_many_values(spark, rows):
    data = [(k, v) for k in range(3) for v in range(100 - k) for _ in range(2)]
    df = spark.createDataFrame(data, "k int, v int")
    assert rows(contains_all_rows(df, ["k"], "v", range(100))) == [(0,)]


def test_samples(spark, rows):
    rolls = spark.createDataFrame([(1, "5"), (1, "5"), (2, "5"), (2, "x"), (2, "-1"), (3, "7")], "sample int, item_id string")
    assert rows(distinct_over_samples(rolls)) == [(5, 2), (7, 1)]


def edge_inputs(spark):
    names = spark.createDataFrame([(i, f"n{i}", f"i{i}") for i in range(1, 10)], "id int, localized_name string, internal_name string")
    transforms = spark.createDataFrame([(5, 77), (6, 0), (7, 8), (8, -1)], "item_id int, to_item_id int")
    equivalents = spark.createDataFrame([(5, 6), (1, 7), (2, 0)], "item_id int, counts_as_id int")
    decraft = spark.createDataFrame([(6, 0), (2, 1), (7, 0), (3, 2), (4, 3), (9, -1)], "item_id int, recipe_index int")
    slot = "array<struct<type:int,name:string,stack:int>>"
    recipes = spark.createDataFrame(
        [
            (0, [(1, "a", 2), None, (1, "a", 2), (1, "a", 0), (0, "", 9), (4, "", 1)], None),
            (1, [(1, "a", 1)], []),
            (2, [(1, "a", 1)], [(3, "c", 4)]),
        ],
        f"recipe_index int, required_items {slot}, custom_results {slot}",
    )
    return edges.edge_names(names), transforms, equivalents, decraft, edges.recipe_outputs(recipes)


def test_edges(spark, rows):
    got = rows(edges.transform_edges(*edge_inputs(spark)))
    assert got == sorted(
        [
            (5, "n5", 77, "Item_77", 1, "item_transform"),
            (7, "n7", 8, "n8", 1, "item_transform"),
            # 5 counts as 6, which has no transform: it decomposes as well as transforms.
            (5, "n5", 1, "n1", 2, "deconstruct"),
            (5, "n5", 1, "n1", 1, "deconstruct"),
            (6, "n6", 1, "n1", 2, "deconstruct"),
            (6, "n6", 1, "n1", 1, "deconstruct"),
            # 1 counts as 7, which has a transform; 2 has an empty custom list; 4's recipe is absent.
            (3, "n3", 3, "n3", 4, "deconstruct"),
        ],
        key=repr,
    )
    ordered = [tuple(r) for r in edges.edge_order(edges.transform_edges(*edge_inputs(spark))).collect()]
    assert ordered == sorted(ordered, key=lambda r: (r[0], r[5], r[2], r[4]))


def test_shop_items(spark):
    slots = spark.createDataFrame(
        [
            (1, 0, 8, False, "Torch", 50, 1), (1, 3, 8, False, "Other", 60, -1), (1, 4, 8, False, "O", 1, 2),
            (1, 1, 9, False, "Wood", 5, -1), (1, 2, 9, False, "Wood", 6, 3), (1, 5, 0, False, "", 0, -1), (1, 6, 4, True, "air", 0, -1),
        ],
        "shop_id int, slot int, item_id int, is_air boolean, name string, buy_price int, special_currency int",
    )
    parsed = spark.createDataFrame([(1, 8, ["a", "b"]), (1, 9, ["c"])], "shop_id int, item_id int, parsed array<string>")
    got = {r["item_id"]: (r["name"], r["buy_price"], list(r["conditions"])) for r in shops.shop_items(slots, parsed).collect()}
    assert got == {
        8: ("Torch", 50, ["specialCurrency=1", "a", "b", "specialCurrency=2"]),
        9: ("Wood", 5, ["c", "specialCurrency=3"]),
    }


def test_shop_sources(spark):
    shop_map = spark.createDataFrame(
        [(1, 17, "Shop 1", False, False), (2, 19, "Shop 2", False, True), (3, 20, "Shop 3", False, False),
         (4, 38, "Shop 4", False, False), (5, 54, "Shop 5", True, False), (6, 55, "Shop 6", True, False), (7, 99, "Shop 7", False, False)],
        "shop_id int, npc_id int, shop_name string, sampled boolean, has_second_source boolean",
    )
    slots = spark.createDataFrame(
        [(1, 0, 8, False, "Torch", 50, -1), (2, 0, 8, False, "Torch", 50, -1)],
        "shop_id int, slot int, item_id int, is_air boolean, name string, buy_price int, special_currency int",
    )
    shops_df = shops.shop_catalog(
        shop_map=shop_map,
        slots=slots,
        runtime_ok=spark.createDataFrame([(1, True), (2, False), (3, False), (4, True), (7, False)], "shop_id int, ok boolean"),
        parsed_items=spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "shop_id int, item_id int"),
        conditions=spark.createDataFrame([(3, 9, "night", 0)], "shop_id int, item_id int, condition string, ord int"),
        second_items=spark.createDataFrame([(2, 10), (3, 10)], "shop_id int, item_id int"),
        rolls=spark.createDataFrame([(5, 0, "11"), (5, 1, "11"), (5, 1, "x")], "shop_id int, sample int, item_id string"),
        constants=spark.createDataFrame([(5, 1200), (6, 999)], "shop_id int, item_id int"),
        item_defaults=spark.createDataFrame([(9, "Wood", 5), (10, "ItemName.Gel", 7), (11, "", 3)], "item_id int, name string, buy_price int"),
        internal_names=spark.createDataFrame([(10, "Gel")], "id int, internal_name string"),
        npc_names=spark.createDataFrame([(17, "Merchant"), (19, " ")], "npc_id int, name string"),
        id_count=1500,
    )
    got = {r["shop_id"]: (r["npc_name"], [(i["item_id"], i["name"], list(i["conditions"])) for i in r["items"]]) for r in shops_df.collect()}
    assert got == {
        1: ("Merchant", [(8, "Torch", [])]),  # first source
        2: ("NPC 19", [(10, "Gel", [])]),  # failed: second source
        3: ("NPC 20", [(9, "Wood", ["night"])]),  # no second source: parsed text
        4: ("NPC 38", []),  # succeeded without items
        5: ("NPC 54", [(11, "Item 11", [])]),  # sampled
        6: ("NPC 55", []),  # sampled, nothing plausible: stays
    }  # 7 failed everywhere


def test_offers_that_cannot_be_chosen_are_not_made(spark):
    shop_map = spark.createDataFrame(
        [(1, 17, "A", False, True), (2, 19, "B", False, True), (3, 20, "C", False, False), (5, 54, "D", True, False)],
        "shop_id int, npc_id int, shop_name string, sampled boolean, has_second_source boolean",
    )
    slots = spark.createDataFrame(
        [(i, 0, 8, False, "Torch", 50, -1) for i in (1, 2, 3, 5)],
        "shop_id int, slot int, item_id int, is_air boolean, name string, buy_price int, special_currency int",
    )
    ids = spark.createDataFrame([(i, 9) for i in (1, 2, 3, 5)], "shop_id int, item_id int")
    offers = shops.shop_offers(
        slots=slots,
        parsed_items=ids,
        parsed=spark.createDataFrame([], "shop_id int, item_id int, parsed array<string>"),
        second_items=ids,
        rolls=spark.createDataFrame([(1, 0, "9"), (5, 0, "9")], "shop_id int, sample int, item_id string"),
        constants=spark.createDataFrame([], "shop_id int, item_id int"),
        item_defaults=spark.createDataFrame([(9, "Wood", 5)], "item_id int, name string, buy_price int"),
        shop_map=shop_map,
        id_count=1500,
        runtime_ok=spark.createDataFrame([(1, True), (2, False), (5, True)], "shop_id int, ok boolean"),
    )
    got = sorted((r["shop_id"], r["priority"], r["item_id"]) for r in offers.collect())
    # 2 failed, and nothing is known of 3: neither has slots that count; 1 succeeded and needs no other source.
    assert got == [(1, 1, 8), (2, 2, 9), (2, 3, 9), (3, 3, 9), (5, 1, 9)]


def test_first_nonempty_source(spark, rows):
    status = spark.createDataFrame(
        [("a", 1, True, 0), ("a", 2, True, 3), ("b", 1, False, 0), ("b", 3, True, 1), ("c", 1, False, 0), ("c", 2, True, 0)],
        "k string, priority int, ok boolean, n_rows bigint",
    )
    data = spark.createDataFrame([("a", 2, "x"), ("b", 3, "y")], "k string, priority int, v string")
    chosen, kept = first_nonempty_source(data, status, ["k"])
    assert rows(chosen) == [("a", 1), ("b", 3)]
    assert rows(kept) == [("b", 3, "y")]


def test_foreign_keys(spark, rows):
    parent = spark.createDataFrame([(1,), (None,)], "id int")
    child = spark.createDataFrame(
        [(7, 1, [(1,), (999,), (None,), None]), (8, None, None), (9, 5, [])],
        "rid int, fk int, ingredients array<struct<item_id:int>>",
    )
    flat = checks.fk_violations(child, F.col("fk"), parent, "id", "d", "fk", F.col("rid"))
    assert rows(flat) == [("d", "8", "fk", None, None), ("d", "9", "fk", 5, None)]
    nested = checks.fk_violations_nested(child, "ingredients", "item_id", parent, "id", "d", "ingredients[].item_id", F.col("rid"))
    assert rows(nested) == sorted(
        [("d", "7", "ingredients[].item_id", 999, 1), ("d", "7", "ingredients[].item_id", None, 2), ("d", "7", "ingredients[]", None, 3)],
        key=repr,
    )
    assert rows(checks.fk_violation_counts(child, "fk", parent, "id")) == [(5, 1), (None, 1)]
    repeated = spark.createDataFrame([(1,), (1,)], "id int")
    assert rows(checks.fk_violations(child, F.col("fk"), repeated, "id", "d", "fk", F.col("rid"), parent_unique=False)) == rows(flat)


def test_dangling_ids_pick_the_same_violations(spark, rows):
    parent = spark.createDataFrame([(1,), (None,)], "id int")
    child = spark.createDataFrame(
        [(7, 1, [(1,), (999,), (None,), None]), (8, None, None), (9, 5, []), (10, 5, [(5,)]), (11, 999, [(1,)])],
        "rid int, fk int, ingredients array<struct<item_id:int>>",
    )
    ids = [(child, F.array("fk")), (child, F.transform("ingredients", lambda x: x["item_id"]))]
    dangling = checks.dangling_ids(ids, parent, "id")
    assert sorted(((r["ref_id"]) for r in dangling.collect()), key=str) == [5, 999, None]
    args = (parent, "id", "d")
    for exempt in (None, F.col("rid") == 9):
        flat = checks.fk_violations(child, F.col("fk"), *args, "fk", F.col("rid"), exempt=exempt)
        again = checks.fk_violations(child, F.col("fk"), *args, "fk", F.col("rid"), exempt=exempt, dangling=dangling)
        assert again.columns == flat.columns and rows(again) == rows(flat)
    nested = checks.fk_violations_nested(child, "ingredients", "item_id", *args, "f", F.col("rid"))
    assert rows(checks.fk_violations_nested(child, "ingredients", "item_id", *args, "f", F.col("rid"), dangling)) == rows(nested)


def test_ranges_and_status(spark):
    rules = [checks.RangeCheck("r", 10, 20)]
    for actual, status in ((9, "FAIL"), (10, "PASS"), (20, "PASS"), (21, "WARN")):
        metrics = spark.createDataFrame([("r", actual)], "metric string, actual bigint")
        row = checks.count_range(metrics, rules).head()
        assert (row["expected"], row["actual"], row["status"]) == ("10-20", actual, status)
    sections = spark.createDataFrame([("a", 0, True), ("b", 2, False)], "section string, n_failures bigint, pass boolean")
    assert tuple(checks.overall_status(sections).head()) == ("FAIL", 1, 1)
    assert tuple(checks.overall_status(sections.filter("pass")).head()) == ("PASS", 1, 0)


def le32(value):
    return value.to_bytes(4, "little", signed=True)


def texture(width=2, height=3, version=5, flags=0, fmt=0, magic=b"XNB", reader=b"a.Texture2DReader, x", cut=0, mips=1, pixels=None):
    pixels = b"\0" * (width * height * 4) if pixels is None else pixels
    payload = bytes([1, len(reader)]) + reader + le32(0) + b"\0\1" + le32(fmt) + le32(width) + le32(height) + le32(mips)
    payload += b"".join(le32(len(pixels)) + pixels for _ in range(max(mips, 0)))
    payload = payload[: len(payload) - cut]
    return magic + b"w" + bytes([version, flags]) + le32(len(payload) + 10) + payload


def test_asset_headers(spark):
    long_reader = b"Texture2DReader" + b"x" * 200
    wide = bytes([1, (len(long_reader) & 127) | 128, len(long_reader) >> 7]) + long_reader
    tail = le32(0) + b"\0\1" + le32(4) + le32(4) + le32(4) + le32(1) + le32(8) + b"\0" * 8
    cases = {
        "valid": (texture(), (0, 2, 3, None)),
        "two mips": (texture(mips=2), (0, 2, 3, None)),
        "long name": (b"XNBw\5\0" + le32(10 + len(wide + tail)) + wide + tail, (4, 4, 4, None)),
        "magic": (texture(magic=b"XNA"), (None, None, None, "invalid magic")),
        "version": (texture(version=3), (None, None, None, "unsupported version")),
        "compressed": (texture(flags=0x80), (None, None, None, "compressed")),
        "lz4": (texture(flags=0xC0), (None, None, None, "lz4 compressed")),
        "no width": (texture(width=0), (None, None, None, "invalid dimensions")),
        "negative": (texture(height=-1, pixels=b""), (None, None, None, "invalid dimensions")),
        "no mips": (texture(mips=0), (None, None, None, "no mip data")),
        "cut": (texture(cut=1), (None, None, None, "truncated")),
        "cut early": (texture()[:14], (None, None, None, "truncated")),
        "tiny": (b"XNB", (None, None, None, "truncated")),
        "empty": (b"", (None, None, None, "invalid magic")),
        "reader": (texture(reader=b"SoundReader"), (None, None, None, "not a texture")),
        "format": (texture(fmt=9), (None, None, None, "unsupported surface format")),
        "short": (texture(pixels=b"\0"), (None, None, None, "pixel data too short")),
    }
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "k string, content binary")
    got = {r["k"]: (r["surface_format"], r["width"], r["height"], r["error"]) for r in asset_header(df).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_asset_manifest(spark):
    files = [("d/Images/NPC_3.xnb", texture()), ("d/Images/item_08.XNB", texture(4, 5)), ("d/Images/Item_7.xnb", texture(magic=b"ZIP")),
             ("d/Images/Item_2.xnb", texture()), ("d/Images/Item_x.xnb", texture()), ("d/Images/Tile_1.xnb", texture())]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    names = spark.createDataFrame([(8, "Torch"), (2, "")], "id int, internal_name string")
    got = [tuple(r)[:6] for r in manifest_order(asset_manifest(assets_of(df), names)).collect()]
    assert got == [
        (2, "item", "Item_2", "sprites/items/Item_2.png", 2, 3),
        (8, "item", "Torch", "sprites/items/item_08.png", 4, 5),
        (3, "npc", "NPC_3", "sprites/npcs/NPC_3.png", 2, 3),
    ]
