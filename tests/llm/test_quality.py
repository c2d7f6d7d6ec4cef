import random
import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from stockloom.llm import quality_classifier as qc
from stockloom.llm import quality_rules as qr
from stockloom.llm.arrow import BATCH_ROWS, WordTable, keep_rows, with_columns

FOLDER = "/root/testdata/sf0.01"


def test_texts_travel_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    frame = spark.range(3)
    try:
        for given, most in ((10_000, BATCH_ROWS), (0, BATCH_ROWS), (100, 100)):
            spark.conf.set(key, given)
            keep_rows(frame, ["id"], lambda: lambda ids: [True] * len(ids))
            assert int(spark.conf.get(key)) == most
            spark.conf.set(key, given)
            with_columns(frame, ["id"], lambda: lambda ids: [ids], [("n", T.LongType(), pa.int64())])
            assert int(spark.conf.get(key)) == most
    finally:
        spark.conf.set(key, before)


def slow_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_counts_match_definition(spark, words):
    texts = [None, "", " \t\n", "x", "a b c d e a b c d e", "a a a a a a a", "\x1cno\x85break here", "l\nl\n\nl\r\n l", "😀 | <é>"]
    texts += [words(i, random.Random(i).randrange(120)) for i in range(40)] + ["w " * 3000 + "v"]
    texts += [words(99, 40)] * 3
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = qr.apply_rules(frame, qr.PRIOR).orderBy("doc_id").collect()
    got = [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows]
    assert got == [slow_rules(t) for t in texts]
    assert all(not r["kept"] for r in rows if r["base_failed"])


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(4)
    for _ in range(40):
        scores, moves = rng.normal(size=6), rng.normal(size=(2, 2))

        def value(states):
            return sum(s for s, x in zip(scores, states) if x) + sum(moves[a, b] for a, b in zip(states, states[1:]))

        best = max(product((0, 1), repeat=6), key=value)
        assert tuple(qr.viterbi(scores, moves)) == best
    assert qr.viterbi(np.zeros(3), np.zeros((2, 2))) == [1, 1, 1]


def test_expectations_match_enumeration():
    rng = np.random.default_rng(5)
    n_features = len(qr.FEATURES)
    emission, moves = rng.normal(size=n_features), rng.normal(size=(2, 2))
    lengths = (4, 2)
    x, present = np.zeros((4, 2, n_features)), np.zeros((4, 2), bool)
    wanted = np.zeros(n_features + 4)
    for i, n in enumerate(lengths):
        x[:n, i], present[:n, i] = rng.normal(size=(n, n_features)), True
        weights, counts = [], []
        for states in product((0, 1), repeat=n):
            score = sum(x[t, i] @ emission for t in range(n) if states[t]) + sum(moves[a, b] for a, b in zip(states, states[1:]))
            features = sum((x[t, i] for t in range(n) if states[t]), np.zeros(n_features))
            steps = np.zeros((2, 2))
            for a, b in zip(states, states[1:]):
                steps[a, b] += 1
            weights.append(np.exp(score))
            counts.append(np.concatenate([features, steps.ravel()]))
        wanted += np.array(weights) @ np.array(counts) / sum(weights)
    assert np.allclose(qr._expectations(x, present, emission, moves), wanted)


def test_trained_field_keeps_clean_documents(spark):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    field = qr.train(documents, labels.filter(~qc.held_out()))
    rows = qr.apply_rules(documents, field, keep=["doc_id"]).join(labels.filter(qc.held_out()), "doc_id").collect()
    clean = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r for r in rows if r["quality"] == 0]
    assert len(clean) > 50 and sum(r["kept"] for r in clean) >= 0.98 * len(clean)
    assert sum(not r["kept"] for r in junk) >= 0.8 * len(junk)


def test_rules_without_labels_or_documents(spark, words):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    schema = "doc_id bigint, text string, kept string, n_words string"
    assert qr.train(spark.createDataFrame([], schema), none) is qr.PRIOR
    text = words(1, 40, ("eins", "zwei", "drei", "vier", "acht", "neun", "sechs", "sieben", "zehn", "elf"), (" ",))
    frame = spark.createDataFrame([(1, text, "k", None), (1, text, "k", None), (None, "x | " * 30, None, "n"), (3, None, None, None)], schema)
    out = qr.filter_documents(frame, qr.PRIOR)
    assert out.columns == frame.columns
    assert [tuple(r) for r in out.collect()] == [(1, text, "k", None)] * 2


def test_vote_matches_brute_force():
    rng = np.random.default_rng(6)
    counts = rng.poisson(0.02, (80, qc.TERMS)).astype(np.float32)
    quality = rng.integers(0, 2, 80)
    model = qc._decompose(counts.copy(), quality, {0: 100, 1: 300})
    assert model.vectors.shape[1] <= qc.RANK
    fresh = rng.poisson(0.02, (10, qc.TERMS)).astype(np.float32)
    fresh[3] = 0
    scores = qc.vote(model, fresh)
    for row, score in zip(fresh, scores):
        vector = np.log1p(row) @ model.projection
        norm = np.linalg.norm(vector)
        near = sorted(
            ((float(vector @ v / norm) if norm else 0.0), g, w) for v, g, w in zip(model.vectors, model.good, model.weight)
        )[-qc.NEIGHBOURS :]
        pull = sum(max(c, 0) * w for c, _, w in near)
        wanted = sum(max(c, 0) * w * g for c, g, w in near) / pull if norm else (model.good * model.weight).sum() / model.weight.sum()
        assert abs(score - wanted) < 1e-4
    assert ((scores >= 0) & (scores <= 1)).all()


def test_term_counts_do_not_depend_on_the_block(words):
    texts = [words(i, 30) for i in range(12)] + [None, "", "ja ja ja ja"]
    table = WordTable(qc._describe, 2, limit=5)
    together = qc.term_counts(texts, table)
    alone = np.concatenate([qc.term_counts([t], WordTable(qc._describe, 2)) for t in texts])
    assert (together == alone).all()


def test_held_out_documents_are_told_apart(spark):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    out = qc.train_and_classify(documents, labels, keep=["doc_id"])
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    good = [r for r in held if r["quality"] == 1]
    assert len(held) > 50
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    assert out.count() == documents.count()


def test_labels_of_held_out_documents_have_no_influence(spark):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    few = documents.filter("doc_id < 60")
    a, b = (qc.classify(few, qc.fit(documents, x.filter(~qc.held_out())), keep=["doc_id"]).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_classifier_edge_cases(spark):
    schema = "doc_id bigint, text string, score string, predicted string"
    rows = [(1, None, "s", None), (1, None, "s", None), (None, "", None, "p"), (4, "y " * 50_000, None, None)]
    frame = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert qc.fit(frame, none) is None
    assert [r["score"] for r in qc.train_and_classify(frame, none).collect()] == [1.0] * 4
    assert qc.keep_good(frame, None).count() == 4
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (None, 0), (7, None)], "doc_id bigint, quality int")
    model = qc.fit(frame, labels)
    out = qc.classify(frame, model).collect()
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == 4
    assert qc.keep_good(frame, model).columns == frame.columns
    assert qc.classify(spark.createDataFrame([], schema), model).count() == 0
