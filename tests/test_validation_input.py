from stockloom.queries import files


def test_validated_recipes_are_of_all_parts(spark, monkeypatch):
    built = {}
    real = files.catalog_phases
    monkeypatch.setattr(files, "catalog_phases", lambda builders: built.update(builders) or real(builders))
    folder = "/root/testdata/sf0.001"
    found = {r["section"]: r["n_failing"] for r in files._catalog_validation(spark, folder).collect()}
    parts = {r[0] for r in spark.read.parquet(f"{folder}/part.parquet").select("p_partkey").collect()}
    assert {r[0] for r in built["recipes"](spark).select("recipe_index").collect()} == parts
    assert len(found) == 5
