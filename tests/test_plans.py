import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from stockloom import schemas
from stockloom.operators.checks import RangeCheck, row_rules
from stockloom.plans.catalog import Phase, catalog_phases, item_catalog, recipe_catalog, run_catalog, run_phase
from stockloom.plans.report import build_report, markdown_report, phase_summary, phase_totals, run_and_validate
from stockloom.plans.validation import load_dataset, manifest_failures, manifest_rules, validate_catalog
from stockloom.sinks import read_run_log
from stockloom.sources import read_table


def test_items(spark, rows):
    raw = spark.createDataFrame([(1, 7, "ItemName.A"), (2, -7, "B"), (0, 5, "zero")], schemas.RAW_ITEMS)
    names = spark.createDataFrame([(1, "a")], schemas.INTERNAL_NAMES)
    assert rows(item_catalog(raw, names)) == [(1, "a", "a", 7, 1), (2, "B", "", -7, -1)]


def test_recipes(spark, rows):
    flags = [False] * len(schemas.RECIPE_FLAGS)
    flags[0] = flags[12] = True
    raw = spark.createDataFrame(
        [
            (0, (8, "", 3), [(23, "Gel", 1), None, (9, " ", 1), (0, "", 0), (5, "x", 1)], [0, 18, -1, 7], *flags, None),
            (4, None, None, [None], *[None] * len(flags), None),
        ],
        schemas.RAW_RECIPES,
    )
    tiles = spark.createDataFrame([(18, "WorkBenches"), (0, " ")], schemas.TILE_NAMES)
    got = {r["recipe_index"]: tuple(r)[1:] for r in recipe_catalog(raw, tiles).collect()}
    ingredients = [tuple(x) for x in got[0][3]]
    assert got[0][:3] == (8, "ItemID.8", 3)
    assert ingredients == [(23, "Gel", 1), (9, "ItemID.9", 1)]
    assert got[0][4] == ["TileID.0", "WorkBenches"] and got[0][5] == ["Water", "CrimsonWorld"]
    assert got[4] == (0, None, 0, [], ["TileID.0"], [])


def test_manifest_rules_depend_on_each_other(spark, rows):
    data = [
        (0, -1, "item", "sprites/items/a.png", 1, 1),
        (1, None, "boss", "anywhere.png", 1, 1),
        (2, 1, " NPC", "\\sprites\\npcs/a.png", 1, 1),
        (3, 1, "item", "sprites/npcs/a.png", 1, 1),
        (4, 1, "item", " ", 0, None),
    ]
    df = spark.createDataFrame(data, "pos int, id int, category string, sprite_file string, width int, height int")
    got = rows(row_rules(df, F.col("pos"), manifest_rules()).select("record_id", "field"))
    assert got == [(0, "id"), (1, "category"), (1, "id"), (3, "spriteFile"), (4, "height"), (4, "spriteFile"), (4, "width")]


def builders(broken=False):
    def items(spark):
        return spark.createDataFrame([(i, f"n{i}", f"i{i}", 5 * i, i) for i in (8, 9, 23, 5353)], schemas.ITEMS)

    def recipes(spark):
        other = 999 if broken else 23
        rows = [(3, 0, 8, "Torch", 3, [(other, "Gel", 1), (9, "Wood", 1)], [], ["AnyWood"])]
        return spark.createDataFrame(rows, schemas.RECIPES)

    def edges(spark):
        return spark.createDataFrame([(8, "Torch", 5353, "Glow", 1, "item_transform"), (8, "Torch", 9, "Wood", 1, "deconstruct")], schemas.EDGES)

    def shops(spark):
        return spark.createDataFrame([(17, "Merchant", "Shop 1", 0, [(8, "Torch", 50, [])])], schemas.SHOPS)

    def sprites(spark):
        rows = [(8, "item", "Torch", "sprites/items/Item_8.png", 2, 2), (1, "npc", "NPC_1", "sprites/npcs/NPC_1.png", 2, 2)]
        if broken:
            rows += [(777, "ITEM ", "x", "sprites/items/Item_777.png", 0, 2), (0, "item", "x", "sprites/npcs/NPC_1.png", 1, 1)]
        return spark.createDataFrame(rows, schemas.MANIFEST)

    return {"items": items, "recipes": recipes, "shimmer": edges, "npc_shops": shops, "sprites": sprites}


SMALL = tuple(
    RangeCheck(name, 1, 3 if name == "items_range" else None)
    for name in ("items_range", "recipes_range", "shimmer_item_transform_range", "shimmer_deconstruct_range",
                 "npc_shops_min", "sprite_manifest_range", "sprite_items_min", "sprite_npcs_min")
)


def pictures(folder):
    for name in ("items/Item_8.png", "npcs/NPC_1.png"):
        path = f"{folder}/sprites/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as handle:
            handle.write(b"png")


def test_run_and_validate(spark, folder):
    pictures(folder)
    phases = catalog_phases(builders())
    assert [p.key for p in phases] == ["items", "shimmer", "recipes", "npc_shops", "sprites"]
    assert run_catalog(spark, phases, folder, "first")
    report = build_report(spark, folder, validate_catalog(spark, folder, SMALL), f"{folder}/t")
    assert report["status"] == "PASS", report
    assert report["counts"]["shimmerTypeBreakdown"] == {"item_transform": 1, "deconstruct": 1}
    assert report["counts"]["items"] == 4
    # Four items are more than the soft maximum: a warning only.
    assert [w["check"] for w in report["checks"]["count_ranges"]["warningRecords"]] == ["items_range"]
    assert report["checks"]["spot_checks"]["details"][1]["evidence"] == {"NpcId": 17, "ShopName": "Shop 1", "ItemId": 8, "BuyPrice": 50}
    text = markdown_report(report)
    assert text.startswith("# Validation Report\n\n- Status: PASS\n") and "items_range (expected `1-3`): WARN" in text
    assert not run_catalog(spark, [Phase("items", "items", lambda s: s.createDataFrame([], schemas.ITEMS))], folder, "second")
    log = read_run_log(spark, f"{folder}/run_log")
    # Totals are those of a run, also in a log of several runs.
    assert sorted(map(tuple, phase_totals(log).collect())) == [("first", 5, 0), ("second", 0, 1)]
    log = log.filter("run_id = 'first'")
    assert {r["outcome"] for r in phase_summary(log).collect()} == {"PASS"}


def test_failures_are_reported(spark, folder):
    pictures(folder)
    assert run_catalog(spark, catalog_phases(builders(broken=True)), folder)
    shutil.rmtree(f"{folder}/npc_shops.json")
    report = build_report(spark, folder, validate_catalog(spark, folder, SMALL), f"{folder}/t")
    checks = report["checks"]
    assert report["status"] == "FAIL" and not any(c["pass"] for c in checks.values())
    assert [f["error"] for f in checks["required_files"]["failingRecords"]] == ["missing", "missing file: npc_shops.json"]
    assert [f["check"] for f in checks["count_ranges"]["failingRecords"]] == ["npc_shops_min"]
    foreign, manifest = (checks[c]["failingRecords"] for c in ("foreign_key_integrity", "sprite_manifest_integrity"))
    assert (foreign["count"], manifest["count"]) == (2, 3)
    found = spark.read.json(foreign["path"]).collect()
    assert sorted((f["dataset"], f["field"], f["ref_id"], f["element_index"]) for f in found) == [
        ("recipes", "Ingredients[].ItemId", 999, 0), ("sprite_manifest", "id", 777, None),
    ]
    # The manifest is in its order; a category in other letters comes last.
    found = spark.read.json(manifest["path"]).collect()
    assert sorted((f["record_id"], f["field"], f["error"][:12]) for f in found) == [
        (0, "spriteFile", "spriteFile m"), (3, "spriteFile", "referenced s"), (3, "width", "width must b"),
    ]
    assert {f["check"] for f in checks["spot_checks"]["failingRecords"]} == {"torch_recipe_exists", "merchant_sells_torch"}
    assert "FAIL" in markdown_report(report)


def test_phases_fail_alone(spark, folder):
    def broken(spark):
        raise RuntimeError("no source")

    empty = run_phase(spark, Phase("items", "items", lambda s: s.createDataFrame([], schemas.ITEMS)), folder)
    assert not empty["succeeded"] and empty["errors"] == ["extracted 0 rows"]
    failed = run_phase(spark, Phase("shimmer", "shimmer", broken), folder)
    assert not failed["succeeded"] and failed["errors"][0] == "extract failed: no source"
    assert json.load(open(f"{folder}/shimmer.json")) == [] and os.path.getsize(f"{folder}/shimmer.csv") == 0
    good = run_phase(spark, Phase("recipes", "recipes", builders()["recipes"]), folder)
    assert good["succeeded"] and good["row_count"] == 1
    phases = [Phase("shimmer", "shimmer", broken), Phase("recipes", "recipes", builders()["recipes"])]
    assert not run_and_validate(spark, phases, f"{folder}/b", f"{folder}/r.json", f"{folder}/r.md")
    assert [r["succeeded"] for r in read_run_log(spark, f"{folder}/b/run_log").orderBy("phase_key").collect()] == [True, False]
    with pytest.raises(ValueError):
        catalog_phases({"other": broken})


def test_reports_are_written(spark, folder):
    pictures(folder)
    # The default thresholds fail on so few rows; both reports are written all the same.
    assert not run_and_validate(spark, catalog_phases(builders()), folder, f"{folder}/r.json", f"{folder}/r.md")
    assert json.load(open(f"{folder}/r.json"))["status"] == "FAIL"
    assert open(f"{folder}/r.md").read().startswith("# Validation Report")


def test_a_failed_run_leaves_nothing_of_an_earlier_one(spark, folder):
    def broken(spark):
        raise RuntimeError("no source")

    assert run_phase(spark, Phase("items", "items", builders()["items"]), folder)["succeeded"]
    assert not run_phase(spark, Phase("items", "items", broken), folder)["succeeded"]
    assert json.load(open(f"{folder}/items.json")) == [] and os.path.getsize(f"{folder}/items.csv") == 0
    assert not os.path.exists(f"{folder}/items.parquet")
    assert read_table(spark, f"{folder}/items.parquet", schemas.ITEMS)[0].count() == 0
    assert run_phase(spark, Phase("items", "items", builders()["items"]), folder)["succeeded"]
    assert spark.read.json(f"{folder}/items.json").count() == 4


def test_corrupt_lines_are_a_load_error(spark, folder):
    os.makedirs(f"{folder}/items.json")
    for name, text in (("part-00001", '{"Id":1,"Name":"b"}\n{"Id":2}\n' * 50), ("part-00000", '{"Id":7}\n{"Id":3\n')):
        with open(f"{folder}/items.json/{name}", "w") as handle:
            handle.write(text)
    records, error = load_dataset(spark, folder, "items", schemas.ITEMS)
    assert error == "invalid json in items.json: 1 lines"
    assert records.count() == 101
    # Positions follow the names of the files, not the order in which Spark reads them.
    assert [(r["pos"], r["id"]) for r in records.orderBy("pos").limit(3).collect()] == [(0, 7), (2, 1), (3, 2)]
    report = build_report(spark, folder, validate_catalog(spark, folder, SMALL), f"{folder}/t")
    assert "invalid json in items.json: 1 lines" in [f["error"] for f in report["checks"]["required_files"]["failingRecords"]]


def test_values_of_the_wrong_type_are_shown(spark, folder):
    with open(f"{folder}/sprite_manifest.json", "w") as handle:
        handle.write('[{"id":1,"category":"item","internalName":"x","spriteFile":"sprites/items/a.png","width":"12","height":2.5}]')
    records, _ = load_dataset(spark, folder, "sprite_manifest", schemas.MANIFEST)
    found = manifest_failures(records, spark.createDataFrame([("sprites/items/a.png",)], "path string")).collect()
    assert sorted((f["field"], f["value"]) for f in found) == [("height", "2.5"), ("width", '"12"')]


def test_a_recipe_in_parts_is_one_recipe(spark, folder):
    def recipes(spark):
        rows = [(3, p, 8, "Torch", 3, [(i, "x", 1)], [], []) for p, i in enumerate((9, 23))]
        return spark.createDataFrame(rows, schemas.RECIPES)

    assert run_catalog(spark, catalog_phases(builders() | {"recipes": recipes}), folder)
    result = validate_catalog(spark, folder, SMALL)
    assert {r["metric"]: r["actual"] for r in result.counts.collect()}["recipes_range"] == 1
    spot = {r["check"]: r for r in result.spots.collect()}["torch_recipe_exists"]
    assert spot["pass"] and json.loads(spot["evidence"])["RecipeIndex"] == 3
