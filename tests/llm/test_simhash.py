import random
from itertools import combinations

import numpy as np
import xxhash

from stockloom.llm import simhash
from stockloom.llm.components import connected_components, joined_components
from stockloom.llm.simhash import CROWD, Plan, fingerprint


def slow_fingerprint(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def near(values, distance=2):
    return [(a, b) for a, b in combinations(values, 2) if bin(a ^ b).count("1") <= distance]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_matches_definition(words):
    texts = [None, "", " \n", "One", "ONE two", "É é É é", "a b c a b c a b c", *(words(i, 50) for i in range(20))]
    assert [fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    assert fingerprint("A B C") == fingerprint("a b\tc") != fingerprint("É b c") != fingerprint("é b c")
    assert fingerprint("x y") != fingerprint("x y")


def test_components_of_chains_stars_and_random_graphs(spark, classes):
    rng = random.Random(1)
    graphs = [
        [(i, i + 1) for i in range(60)],
        [(0, i) for i in range(1, 80)] + [(200, 201), (201, 200), (5, 5)],
        [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
    ]
    for pairs in graphs:
        found = connected_components(spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")).collect()
        wanted = classes([p for p in pairs if p[0] != p[1]])
        assert {r["node"] for r in found} == set(wanted)
        groups = {}
        for r in found:
            groups.setdefault(r["component"], set()).add(r["node"])
        expected = {}
        for node, root in wanted.items():
            expected.setdefault(root, set()).add(node)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def values_with_neighbours(seed, n=150):
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(n)}
    for v in list(values)[:60]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.choice((1, 2, 3))):
                v ^= 1 << b
            values.add(v)
    # A crowd: more near values than a bucket may pair, some linked only through others.
    core = rng.getrandbits(64)
    for b in range(2 * CROWD):
        values.add(core ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    return sorted(values)


def test_every_allocation_finds_all_links(spark, classes):
    values = values_with_neighbours(3)
    wanted = classes(near(values))
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp bigint").cache()
    n, together = simhash.bit_statistics(frame)
    assert n == len(values)
    bits = np.array([[v >> b & 1 for b in range(64)] for v in values])
    assert (together == bits.T @ bits).all()
    plans = [simhash._allocate(n, together, parts, 2)[1] for parts in (1, 2, 3)]
    assert all(sum(p.thresholds) == 2 - len(p.masks) + 1 for p in plans)
    assert all(sum(p.masks) == (1 << 64) - 1 for p in plans)
    for plan in [*plans[1:], Plan(plans[1].masks, (1, 0)), Plan(plans[1].masks, (2, -1)), Plan(plans[2].masks, (0, 1, -1))]:
        pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame, plan).collect()]
        assert all(bin(a ^ b).count("1") <= 2 for a, b in pairs)
        found = classes(pairs)
        assert set(found) == set(wanted)
        assert {frozenset(x for x in found if found[x] == r) for r in set(found.values())} == {
            frozenset(x for x in wanted if wanted[x] == r) for r in set(wanted.values())
        }
    # A crowd gives no pairs: rows grow with its members only.
    assert simhash.links(frame, plans[2]).count() < 65 * len(values)


def test_component_is_smallest_reachable_id(spark, classes):
    values = values_with_neighbours(5, 60)
    rng = random.Random(2)
    rows = [(i, signed(rng.choice(values))) for i in range(400)] + [(None, signed(values[0])), (3, signed(values[1]))]
    found = {r["fp"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, fp bigint")).collect()}
    present = sorted({f % (1 << 64) for _, f in rows})
    roots = classes(near(present)) | {}
    smallest = {}
    for i, f in rows:
        root = roots.get(f % (1 << 64), f % (1 << 64))
        if i is not None:
            smallest[root] = min(i, smallest.get(root, i))
    assert found == {signed(f): smallest.get(roots.get(f, f)) for f in present}


def test_deduplicate_keeps_one_of_each_group(spark):
    schema = "doc_id bigint, text string, lang string, fp string, component_id string"
    rows = [
        (5, "a b c d", "x", "p", None), (2, "A b c d", "y", None, "q"), (2, "A b c d", "y", None, "q"), (9, None, None, None, None),
        (8, " ", None, None, None), (7, "other words stand here", None, None, None), (None, "a b c d", None, None, None),
        (None, "nothing like the rest", None, None, None), (None, "nothing like the rest", None, None, None),
    ]
    out = simhash.deduplicate(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "lang", "fp", "component_id"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([rows[1], rows[4], rows[5], rows[7]], key=repr)
    assert simhash.deduplicate(spark.createDataFrame([], schema)).count() == 0


def test_deduplicate_decides_unlike_texts_of_one_id_apart(spark):
    rows = [
        (1, "a b c d", "x"), (2, "a b c d", "x"), (2, "quite another text stands here", "x"), (3, "words of its own", "q"),
        (3, "words of its own", "p"), (3, "nothing like the rest of them", "x"), (4, "A B C D", "x"), (4, "a b c d", "x"),
        (5, "one text", "x"), (5, "second thing", "x"), (6, "one text", "x"), (None, "lonely words", "x"), (None, "lonely words", "x"),
    ]
    wanted = {(r[0], r[1]) for r in rows} - {(2, "a b c d"), (4, "A B C D"), (4, "a b c d"), (6, "one text")}
    for order in (rows, rows[::-1]):
        out = [tuple(r) for r in simhash.deduplicate(spark.createDataFrame(order, "doc_id bigint, text string, source string").repartition(3)).collect()]
        assert len(out) == len(wanted) and {r[:2] for r in out} == wanted
        ties = {r[2] for r in out if r[1] == "words of its own"}
        assert order is rows or ties == before
        before = ties


def test_further_links_join_known_components(spark, classes):
    rng = random.Random(11)
    star = [(1_000, i) for i in range(1_001, 1_400)]
    first = star + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)] + [(1_390, 2), (7, 7), (None, 5)]
    known = connected_components(spark.createDataFrame(first, "a bigint, b bigint"))
    found = joined_components(known, spark.createDataFrame(more, "a bigint, b bigint")).collect()
    assert len({r["node"] for r in found}) == len(found)
    links = [p for p in first + more if None not in p and p[0] != p[1]]
    expected = classes(links)
    assert {r["node"] for r in found} == set(expected)
    groups = lambda pairs: {frozenset(n for n, c in pairs if c == k) for _, k in pairs}
    assert groups([(r["node"], r["component"]) for r in found]) == groups(list(expected.items()))
    assert {r["node"]: r["component"] for r in joined_components(known, spark.createDataFrame([], "a bigint, b bigint")).collect()} == {
        r["node"]: r["component"] for r in known.collect()
    }
