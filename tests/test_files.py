import csv
import glob
import json
import os

from pyspark.sql import functions as F

from stockloom.operators import scans
from stockloom import schemas
from stockloom.sinks import (
    append_run_log,
    parse_run_log,
    public_names,
    read_run_log,
    write_csv_flat,
    write_json,
    write_placeholder,
)
from stockloom.sources.files import existing
from stockloom.sources import (
    as_typed,
    list_assets,
    list_files,
    read_json_array,
    read_lines,
    read_table,
    required_files,
    walk_files,
)

import pytest


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as handle:
        handle.write(data if isinstance(data, bytes) else data.encode())
    return path


def test_json_arrays(spark, folder):
    assert read_json_array(spark, f"{folder}/none.json")[1] == "missing file: none.json"
    assert read_json_array(spark, put(folder, "a.json", "{"))[1] == "invalid json in a.json"
    assert read_json_array(spark, put(folder, "b.json", '{"a":1}'))[1] == "invalid json shape in b.json: expected array"
    records, error = read_json_array(spark, put(folder, "c.json", '[{"Id":1,"N":"x"},5,{"Id":true},{"Id":2.0},{"Id":"5"},null]'))
    assert error is None
    got = records.orderBy("pos").select("pos", "is_object", F.to_json("record")).collect()
    assert [(r[0], r[1]) for r in got] == [(0, True), (1, False), (2, True), (3, True), (4, True), (5, False)]
    assert json.loads(got[1][2]) == {"_raw": 5}
    typed = as_typed(records, schemas.struct(id=schemas.INT, n=schemas.TEXT), {"": {"id": "Id", "n": "N"}})
    assert [(r["id"], r["n"]) for r in typed.orderBy("pos").collect()] == [(1, "x")] + [(None, None)] * 5


BROKEN = ["[1,2", "[1,,2]", '["a"] ["b"]', "[2} {3]", "[1],[2]", '["a,b]', '["a\\,b"]', "x,[1]"]


@pytest.mark.parametrize("text", BROKEN)
def test_broken_arrays(spark, folder, text):
    assert read_json_array(spark, put(folder, "a.json", text))[1] == "invalid json in a.json"


def test_array_across_splits(spark, folder):
    tricky = ["a,b", '",[', "\\", '\\",{', "]}", "é,\u2028", "", "\n,\t", "[[[,", '\\\\",\\"']
    values = [{"k": i, tricky[i % 10] + "k": [tricky[i % 7], {"x": [i, [tricky[i % 3]]]}], "n": None} for i in range(60)]
    values += [*tricky, 5, 1.5, None, True, [], {}, [[], [{}]], {"_raw": 1}]
    put(folder, "many/1.json", json.dumps(values, indent=1) + " \n")
    put(folder, "many/2.json", " [ ]")
    put(folder, "many/3.json", "\n[7,{}]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        records, error = read_json_array(spark, f"{folder}/many")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert error is None
    got = [(r["pos"], r["is_object"], json.loads(r["j"])) for r in records.select("pos", "is_object", F.to_json("record").alias("j")).orderBy("pos").collect()]
    values += [7, {}]
    assert got == [(i, isinstance(v, dict), v if isinstance(v, dict) else {"_raw": v}) for i, v in enumerate(values)]
    assert read_json_array(spark, put(folder, "empty.json", "[ \n]"))[0].count() == 0
    put(folder, "many/4.json", '{"a":[1,2]}')
    assert read_json_array(spark, f"{folder}/many")[1] == "invalid json shape in many: expected array"


def test_an_array_is_stored_by_elements(spark, folder):
    """What is stored grows with the elements and the splits, not with the pieces between commas."""
    before = len(scans._written)
    records, error = read_json_array(spark, put(folder, "a.json", json.dumps([{"L": list(range(50))}] * 200)))
    assert error is None and records.count() == 200
    assert sum(spark.read.parquet(path).count() for path in scans._written[before:]) < 250


def test_files_of_one_folder_are_written_and_measured_by_many_tasks(spark, folder):
    from stockloom.sinks import write_named_files

    names = spark.range(0, 400, 1, 1).select(F.concat(F.lit("n"), "id").alias("name"), F.repeat(F.lit("x"), F.col("id").cast("int")).cast("binary").alias("content"))
    assert write_named_files(names, folder) == 400
    files = walk_files(spark, folder)
    assert sorted(r["length"] for r in files.collect()) == list(range(400))
    assert files.select(F.col("_metadata.file_path")).distinct().count() > 1


@pytest.mark.parametrize("split", ["128m", "16"])
def test_lines_across_splits(spark, folder, split):
    body = b"one\r\ntwo\n\nfour\rfive and a longer line\n" + b"".join(b"line %d\n" % i for i in range(40))
    path = put(folder, "t.txt", body)
    wanted = body.decode().replace("\r\n", "\n").replace("\r", "\n").split("\n")[:-1]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = [(r["line_no"], r["line"]) for r in read_lines(spark, path).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(wanted, 1))


def test_listings(spark, folder, rows):
    for name in ("Item_8.xnb", "item_9.XNB", "NPC_1.xnb", "Item_x.xnb", "deep/Item_5.xnb"):
        put(folder, f"Images/{name}", b"..")
    assets = list_assets(spark, f"{folder}/Images")
    assert rows(assets.select("id", "category", "sprite_file")) == [
        (1, "npc", "sprites/npcs/NPC_1.png"), (8, "item", "sprites/items/Item_8.png"), (9, "item", "sprites/items/item_9.png"),
    ]
    assert "content" not in assets.columns
    assert "content" in list_assets(spark, f"{folder}/Images", with_content=True).columns
    listing = list_files(spark, f"{folder}/Images", recursive=True)
    assert ("deep/Item_5.xnb",) in rows(listing.select("path"))
    expected = spark.createDataFrame([("Item_8.xnb",), ("gone",)], "file string")
    assert rows(required_files(expected, listing)) == [("Item_8.xnb", True), ("gone", False)]
    assert rows(list_files(spark, f"{folder}/absent")) == []


def test_walk_goes_level_by_level(spark, folder, rows):
    names = ["a.png", "x+y z.png", "é%20.png", "b.PNG", "_c.png", ".d.png", "p/q/r/e.png", "p/f.txt", "p/_g/h.png", "p/q/i[1].png"]
    for k, name in enumerate(names):
        put(folder, f"w/{name}", b"." * (k % 3))
    os.symlink(f"{folder}/w", f"{folder}/w/p/again")
    found = walk_files(spark, f"{folder}/w/", "*.png", recursive=True)
    wanted = {n: k % 3 for k, n in enumerate(names) if n.endswith(".png") and n not in ("_c.png", ".d.png", "p/_g/h.png")}
    assert {r["path"].split("/w/")[1]: r["length"] for r in found.collect()} == wanted
    assert found.filter("error IS NOT NULL").isEmpty()
    assert {r["path"] for r in list_files(spark, f"{folder}/w", "[a-b].[pP]?[gG]").collect()} == {"a.png", "b.PNG"}
    assert {r["path"] for r in list_files(spark, f"{folder}/w", recursive=True).collect()} == {*wanted, "b.PNG", "p/f.txt", "p/q/i[1].png"}
    # A file in the place of a folder can't be listed.
    assert [r["error"].split(":")[0] for r in walk_files(spark, f"{folder}/w/a.png").collect()] == ["NotADirectoryError"]


def test_a_failed_listing_is_no_result(spark, folder, rows):
    put(folder, "w/Item_1.xnb", b"..")
    # A file in the place of a folder can't be listed, which is not the same as an empty folder.
    for listing in (list_assets, list_files):
        with pytest.raises(OSError, match="NotADirectoryError"):
            listing(spark, f"{folder}/w/Item_1.xnb")
        assert listing(spark, f"{folder}/w").count() == 1
    assert [r["length"] for r in walk_files(spark, f"{folder}/w/Item_1.xnb").collect()] == [None]
    # A link to nothing is no file, but an asset of that name can't be read.
    os.symlink(f"{folder}/gone", f"{folder}/w/Item_2.xnb")
    assert rows(list_files(spark, f"{folder}/w")) == [("Item_1.xnb", 2)]
    with pytest.raises(OSError, match="Item_2.xnb: BrokenLink"):
        list_assets(spark, f"{folder}/w")
    # A link to itself can't even be looked at.
    os.symlink(f"{folder}/w/loop", f"{folder}/w/loop")
    with pytest.raises(OSError, match="can't be read"):
        list_files(spark, f"{folder}/w")


def test_typed_tables(spark, folder, rows):
    table, warning = read_table(spark, f"{folder}/none", schemas.ITEMS)
    assert warning and rows(table) == [] and table.columns == schemas.ITEMS.fieldNames()
    spark.createDataFrame([(1, "a")], "id int, internal_name string").write.parquet(f"{folder}/t")
    table, warning = read_table(spark, f"{folder}/t", schemas.INTERNAL_NAMES)
    assert warning is None and rows(table) == [(1, "a")]


def read_csv(path):
    out = []
    for part in sorted(glob.glob(f"{path}/*.csv")):
        with open(part, newline="") as handle:
            out.append(handle.read())
    return out


def test_csv(spark, folder):
    df = spark.createDataFrame(
        [('a,"b', "l1\nl2", " sp ", None, ["x", None, "y"], True)], "a string, b string, c string, d int, e array<string>, f boolean"
    ).coalesce(1)
    write_csv_flat(df, f"{folder}/c")
    assert read_csv(f"{folder}/c") == ['a,b,c,d,e,f\n"a,""b","l1\nl2", sp ,,x;;y,True\n']
    assert list(csv.reader(read_csv(f"{folder}/c")[0].splitlines(keepends=True)))[1][:2] == ['a,"b', "l1\nl2"]
    write_csv_flat(df.limit(0), f"{folder}/d", header=list("ABCDEF"), line_end="\r\n")
    assert read_csv(f"{folder}/d") == ["A,B,C,D,E,F\r\n"]
    recipe = spark.sql("select 1 recipe_index, array(named_struct('item_id',23,'name','Gel','count',1)) ingredients").coalesce(1)
    write_csv_flat(recipe, f"{folder}/e")
    assert read_csv(f"{folder}/e") == ["recipe_index,ingredients\n1,23:Gelx1\n"]


def test_json_output(spark, folder):
    shops = spark.sql(
        "select 17 npc_id, cast(null as string) npc_name, 'Shop 1' shop_name,"
        " array(named_struct('item_id',8,'name','Torch','buy_price',50,'conditions',array('a'))) items"
    )
    public = public_names(shops, "npc_shops")
    wanted = {"NpcId": 17, "NpcName": None, "ShopName": "Shop 1", "Part": 0, "Items": [{"ItemId": 8, "Name": "Torch", "BuyPrice": 50, "Conditions": ["a"]}]}
    write_json(public, f"{folder}/lines")
    text = "".join(open(p).read() for p in glob.glob(f"{folder}/lines/*.json"))
    assert json.loads(text) == wanted


def test_placeholders_and_run_log(spark, folder, rows):
    made = write_placeholder(spark, f"{folder}/x.json", f"{folder}/x.csv")
    assert len(made) == 2 and open(f"{folder}/x.json").read() == "[]" and open(f"{folder}/x.csv").read() == ""
    # What is there is replaced, also where it is a folder.
    spark.range(3).write.json(f"{folder}/y.json")
    spark.range(3).write.parquet(f"{folder}/y.parquet")
    write_placeholder(spark, f"{folder}/y.json", f"{folder}/x.csv", f"{folder}/y.parquet")
    assert open(f"{folder}/y.json").read() == "[]" and not os.path.exists(f"{folder}/y.parquet")
    assert rows(read_run_log(spark, f"{folder}/log")) == []
    row = ("r1", "items", "items", 3, True, "j", "c", 12, ["e"])
    for _ in range(2):
        append_run_log(spark.createDataFrame([row], schemas.RUN_LOG), f"{folder}/log")
    assert rows(read_run_log(spark, f"{folder}/log")) == [(*row[:8], ["e"])] * 2
    raw = spark.createDataFrame(
        [("r", None, "k", "x", "yes", None, "c", "9", ["", "e"])],
        "run_id string, phase_name string, phase_key string, row_count string, succeeded string, json_path string, csv_path string, elapsed_ms string, errors array<string>",
    )
    assert rows(parse_run_log(raw)) == [("r", "", "k", 0, False, "", "c", 9, ["e"])]


def test_listings_hold_empty_files_and_odd_names(spark, folder, rows):
    for name, text in (("a+b c.png", "x"), ("empty.png", ""), ("sub/é%20.png", "yy"), ("other.txt", "z")):
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        put(folder, name, text)
    assert rows(list_files(spark, folder, "*.png", recursive=True)) == [("a+b c.png", 1), ("empty.png", 0), ("sub/é%20.png", 2)]
    assert rows(list_files(spark, f"{folder}/none")) == []
    spark.range(3).write.parquet(f"{folder}/t.parquet")
    found = existing(spark, folder, ["t.parquet", "empty.png", "absent"])
    assert rows(found) == [("absent", False), ("empty.png", True), ("t.parquet", True)]


def test_unreadable_tables_are_empty(spark, folder):
    os.makedirs(f"{folder}/bad")
    put(f"{folder}/bad", "part-0.parquet", "no table")
    table, warning = read_table(spark, f"{folder}/bad", schemas.ITEMS)
    assert table.count() == 0 and warning.startswith("unreadable table")
