import os
from itertools import combinations

import duckdb
import pytest

import corpus_pipeline
from stockloom.llm import bpe, mixing, quality_classifier, quality_rules
from stockloom.llm.queries import ORACLES, QUERIES
from tools.check_queries import canonical

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def connect(folder):
    db = duckdb.connect()
    for file in os.listdir(folder):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return db


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    wanted = connect(FOLDER).sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert canonical(got) == canonical(wanted)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_empty_tables(spark, tmp_path, name):
    for file in os.listdir(FOLDER):
        spark.read.parquet(f"{FOLDER}/{file}").limit(0).write.parquet(f"{tmp_path}/{file}")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_stand_nulls_repeats_and_extra_columns(spark, tmp_path, name):
    for file in os.listdir(FOLDER):
        frame = spark.read.parquet(f"{FOLDER}/{file}")
        rows = frame.limit(30)
        none = spark.createDataFrame([tuple(None for _ in frame.columns)], frame.schema)
        both = rows.unionByName(rows.limit(10)).unionByName(none).unionByName(none)
        both.selectExpr("*", "'x' AS fp", "1 AS score", "'y' AS _key", "2 AS probability").write.parquet(f"{tmp_path}/{file}")
    n = spark.read.parquet(f"{tmp_path}/documents.parquet").count()
    found = QUERIES[name](spark, str(tmp_path))
    if name in ("op2_quality_rules", "op3_license_scan", "op5_quality_classifier", "op6_weighted_fingerprints", "op7_bpe_lexicon", "op8_mixing", "op10_simhash_near_dedup", "op13_partial_matching"):
        assert found.count() == n
    else:
        found.collect()


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_is_its_stages(spark, classes):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "mixing", "bpe_encoding"]
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter(~quality_classifier.held_out())
    columns, rows = documents.columns, {r["doc_id"]: r for r in documents.collect()}
    docs = documents
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        kept = {r["doc_id"]: r for r in out.collect()}
        if at < 4:
            assert out.columns == columns
            assert all(kept[i] == rows[i] for i in kept)
        if name == "quality_classifier":
            scored = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).collect()
            wanted = {r["doc_id"] for r in scored if r["predicted"] == 1}
        elif name == "quality_rules":
            judged = quality_rules.apply_rules(docs, quality_rules.train(docs, labels)).collect()
            wanted = {r["doc_id"] for r in judged if r["kept"]}
        elif name == "simhash_near_dedup":
            sets = {i: five_words(r["text"]) for i, r in given.items()}
            near = [(i, j) for i, j in combinations(sets, 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
            roots = classes([(i, i) for i in sets] + near)
            wanted = {min(j for j in roots if roots[j] == root) for root in set(roots.values())}
        elif name == "mixing":
            wanted = {r["doc_id"] for r in mixing.sample(docs, mixing.probabilities(docs)).collect() if r["kept"]}
        else:
            wanted = set(given)
            with open(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")) as file:
                vocabulary = bpe.Vocabulary(file.read())
            for i, r in kept.items():
                ids = [x for w in given[i]["text"].encode().split() for x in vocabulary.word(w)]
                assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert set(kept) == wanted and kept
        docs = spark.createDataFrame([given[i] for i in kept], documents.schema)
    whole = {tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens").collect()}
    assert whole == {(i, r["n_tokens"]) for i, r in kept.items()}
