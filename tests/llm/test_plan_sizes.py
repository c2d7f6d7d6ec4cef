"""Iterations keep the plans of their steps small: the driver holds plans and figures of all queries of a session."""

import pytest

from stockloom.llm import mixing, quality_classifier, quality_rules, simhash

FOLDER = "/root/testdata/sf0.001"


def n_joins(frame):
    return sum("Join " in line for line in frame._jdf.queryExecution().optimizedPlan().toString().splitlines())


def watch(monkeypatch, module, name):
    """Joins of the frames that are given to a function of the module."""
    seen, real = [], getattr(module, name)

    def spy(frame, *args, **named):
        seen.append(n_joins(frame))
        return real(frame, *args, **named)

    monkeypatch.setattr(module, name, spy)
    return seen


def test_steps_of_a_sweep_are_stored_one_by_one(spark, monkeypatch):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = watch(monkeypatch, mixing, "materialize")
    assert mixing.probabilities(documents).count() > 0
    assert len(seen) > 10
    assert max(seen) <= 3


def test_figures_of_a_sweep(spark):
    rows = [("a", "x", "t", 0.2, 0.1), ("a", "y", "t", 0.2, 0.3), ("b", "x", "u", 0.6, 0.6)]
    swept = spark.createDataFrame(rows, "source string, lang string, topic string, weight double, _before double")
    goals = [("source", "a", 0.5), ("source", "b", 0.5), ("source", "absent", 0.1), ("lang", "x", 0.8), ("lang", "y", 0.16)]
    goal = spark.createDataFrame(goals, "dimension string, value string, goal double")
    error, moved = mixing._figures(swept, goal, ["source", "lang"])
    assert error == pytest.approx(0.25)
    assert moved == pytest.approx(0.2)
    assert mixing._figures(swept.limit(0), goal, ["source", "lang"]) == (None, None)


@pytest.mark.parametrize(("module", "train"), [(quality_classifier, "fit"), (quality_rules, "train")])
def test_labelled_ids_are_looked_up_once(spark, monkeypatch, module, train):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    seen = watch(monkeypatch, module, "with_columns")
    assert getattr(module, train)(documents, labels) is not None
    assert seen == [1]


def test_probes_are_read_twice(spark):
    fingerprints = spark.range(40).selectExpr("id * 977 AS fp")
    plan = simhash.plan_probes(fingerprints)
    parts = sum(t >= 0 for t in plan.thresholds)
    # An exclusion for each part, the pairs and the centres.
    assert n_joins(simhash.links(fingerprints, plan)) <= parts + 2
