import random
from itertools import combinations

import corpus_pipeline
from stockloom.llm import near_copies, simhash


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows, classes):
    """Smallest id of each component of pairs with a similarity of at least 0.8, all pairs compared."""
    sets = {i: slow_set(t) for i, t in rows}
    same = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    roots = classes([(i, i) for i in sets] + [(i, j) for i, j in combinations(sets, 2) if same(sets[i], sets[j])])
    smallest = {}
    for i, root in roots.items():
        smallest[root] = min(i, smallest.get(root, i))
    return set(smallest.values())


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def test_stage_drops_edited_copies(spark, classes):
    rng = random.Random(4)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice((40, 120, 400)))] for _ in range(25)]
    texts = [" ".join(b) for b in bases] + [edited(rng, b, n) for b in bases for n in (0, 1, 2, len(b) // 40, len(b) // 10)]
    texts += ["", None, "two words", "Two  words", "two words more"]
    # A crowd: copies of one text, too many for pairs, some of them near others only through a third.
    crowd = [f"c{i}" for i in range(300)]
    texts += [edited(rng, crowd, rng.choice((1, 2, 3, 4, 5, 6))) for _ in range(2 * near_copies.CROWD)]
    # Another: one long passage with own words, so that its bucket holds many components.
    texts += [" ".join([*crowd[:60], *(f"o{k}_{i}" for i in range(k % 25))]) for k in range(2 * near_copies.CROWD)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = slow_kept(rows, classes)
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, documents, "").collect()]
    assert sorted(kept) == sorted(wanted)
    # The rule of two differing bits leaves most edited copies.
    assert simhash.deduplicate(documents).count() > 1.5 * len(wanted)


def test_defined_cases(spark):
    same = " ".join(f"s{i}" for i in range(40))
    other = " ".join(f"o{i}" for i in range(40))
    long = " ".join(f"l{i}" for i in range(120_000))
    texts = [(1, same), (1, other), (2, same), (2, same), (3, None), (4, ""), (None, same + " x"), (None, "nameless words only"), (5, long), (6, long + " end")]
    schema = "doc_id bigint, text string, fp string, hashes int, bands int, n int"
    documents = spark.createDataFrame([(i, t, "f", 1, 2, 3) for i, t in texts], schema)
    found = near_copies.deduplicate(documents)
    assert found.columns == documents.columns
    # The id with two texts keeps both; the wordless stay once; the nameless text that is like no other stays.
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == sorted(
        [(1, same), (1, other), (3, None), (None, "nameless words only"), (5, long)], key=repr
    )
    assert near_copies.deduplicate(documents.limit(0)).count() == 0


def test_stage_links_texts_by_their_fingerprints(spark, monkeypatch):
    """Without the prefix filter, the stage drops just the near copies whose SimHash differs in two bits at most."""
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(12)]
    texts = [" ".join(b) for b in bases] + [" ".join([*b, f"n{k}"]) for k, b in enumerate(bases)]
    sims = [simhash.majority(near_copies.shingle_set(t)) for t in texts]
    alike = [(i, j) for i, j in combinations(range(len(texts)), 2) if (sims[i] ^ sims[j]).bit_count() <= simhash.DISTANCE]
    assert alike and all(j == i + len(bases) for i, j in alike)
    prefixes = near_copies.prefixes
    monkeypatch.setattr(near_copies, "prefixes", lambda *given: prefixes(*given).limit(0))
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, documents, "").collect()}
    assert kept == set(range(len(texts))) - {j for _, j in alike}
