import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from stockloom.llm import fixity, mixing, tool_calls, url_filter
from stockloom.llm.url_filter import Rule

RULES = (Rule("allow", "org/"), Rule("block", "bad.org/x/"), Rule("block", "net/de"), Rule("allow", "a.net/de/ok"), Rule("allow", "org/"))


# URL filter


def slow_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.pattern), default=None)


def test_blocks_spread_over_aliases(spark):
    canonical = '<link href="{}" rel=canonical>'
    refresh = "<META content='0; URL={}' HTTP-EQUIV=refresh>"
    pages = [
        (1, "http://A.net/de/1", None),
        (2, "http://c.com/1#top", canonical.format("http://a.net/de/1")),
        (3, "http://c.com/2?a=1&b=2", refresh.format("http://c.com/1")),
        (4, "http://d.com/dir/4", canonical.format("../2?no") + canonical.format("//c.com/2?a=1&amp;b=2")),
        (5, "http://a.net/de/ok", canonical.format("/de/1")),
        (6, "http://e.com/6", "<!-- " + canonical.format("http://a.net/de/1") + " --> canonical"),
        (7, "http://c.com/1", ""),
        (8, None, canonical.format("http://a.net/de/1")),
        (9, "mailto:x", canonical.format("http://a.net/de/1")),
        (10, "http://bad.org/x/", canonical.format("http://f.org/")),
        (11, "http://f.org", None),
        (12, "x://y://net/de", None),
        (13, "http://notnet/de", None),
        (14, "http://g.com/a/b", canonical.format("c")),
        (15, "http://net/de", canonical.format("http://g.com/a/c")),
        (16, "http://c.com/3", canonical.format("javascript:x") + canonical.format("#y") + canonical.format("http://c.com/3#z")),
        (7, "http://c.com/1", ""),
    ]
    frame = spark.createDataFrame([(*p, "h") for p in pages], "page_id bigint, url string, html string, host string")
    out = url_filter.judge(frame, RULES)
    assert out.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    rows = out.collect()
    got = {r["page_id"]: r["verdict"] for r in rows}
    blocked = {1, 2, 3, 4, 7, 10, 11, 14, 15}  # 11 has no path, so no rule fits it
    assert len(rows) == len(pages)
    assert {p for p, v in got.items() if v == "block"} == blocked
    by = {r["page_id"]: r for r in rows}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"]) == ("a.net", "/de/1", "net/de")
    assert (by[8]["host"], by[8]["path"], by[8]["rule"]) == ("", "", None)
    assert (by[11]["path"], by[11]["rule"]) == ("", None)
    assert (by[12]["host"], by[12]["path"]) == ("y:", "//net/de")
    assert by[5]["rule"] == "a.net/de/ok" and by[10]["rule"] == "bad.org/x/"
    assert url_filter.judge(frame.limit(0), RULES).count() == 0


def test_random_aliases_match_brute_force(spark, classes):
    rng = random.Random(3)
    hosts = ["a.org", "bad.org", "c.net", "net", "d.com", "e.com", "f.com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['x/', 'de', 'en', ''])}{rng.randrange(9)}" for _ in range(150)]
    edges = [(rng.choice(urls), rng.choice(urls)) for _ in range(90)]
    frame = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    log = spark.createDataFrame(edges, "a string, b string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in url_filter.judge(frame, RULES, log).collect()}
    root = classes([e for e in edges if e[0] != e[1]])
    rule = {u: slow_rule(u.split("/")[2], u[len("http://" + u.split("/")[2]) :], RULES) for u in {*urls, *root}}
    bad = {root[u] for u in root if rule[u] and rule[u].action == "block"}
    for u in urls:
        wanted = rule[u].action if rule[u] else "block" if root.get(u) in bad else "allow"
        assert got[u] == (rule[u].pattern if rule[u] else None, wanted)


# Fixity


def test_audit_finds_exactly_the_damage(spark):
    rng = random.Random(4)
    master = [(f"w{rng.randrange(3) if i % 3 else 0}", i * 7 - 300, f"record {i} " + "x" * rng.randrange(40)) for i in range(700)]
    master += [("w1", 5_000, "same"), ("w1", 5_000, "same"), ("w1", 5_000, "other"), (None, None, "nameless"), ("w2", 6_000, "")]
    replica, wanted = [], set()
    for archive, id_, payload in master:
        kind = rng.choice(["ok"] * 30 + ["missing", "resized", "altered"]) if id_ is not None and id_ < 5_000 else "ok"
        changed = {"ok": payload, "missing": None, "resized": payload + "é", "altered": "R" + payload[1:]}[kind]
        replica.append((archive, id_, changed))
        if kind != "ok":
            wanted.add((archive, id_, kind))
    replica.append(("w9", 1, "extra"))
    rng.shuffle(replica)
    schema = "archive string, id bigint, payload string"
    a, b = spark.createDataFrame(master, schema), spark.createDataFrame(replica, schema)
    rows = fixity.audit(a, b.withColumn("extra", F.lit(1))).collect()
    assert {(r["archive"], r["id"], r["kind"]) for r in rows} == wanted | {("w9", 1, "unlisted")}
    # Byte ranges are those of the master's records in a row.
    at, place = {}, {}
    for archive, id_, payload in sorted((m for m in master if m[0]), key=lambda m: (m[0], m[1])):
        n, offset = at.get(archive, (0, 0))
        place[archive, id_] = (n, offset, len(payload.encode()))
        at[archive] = (n + 1, offset + len(payload.encode()))
    for r in rows:
        if r["kind"] != "unlisted":
            assert (r["ordinal"], r["offset"], r["size"]) == place[r["archive"], r["id"]]
    assert fixity.audit(a, a).count() == 0
    assert fixity.audit(a.limit(0), a.limit(0)).count() == 0
    assert {r["kind"] for r in fixity.audit(a, a.limit(0)).collect()} == {"missing"}


def test_trees_descend_only_where_hashes_differ(spark):
    rows = [("r", "w", i, i, i + 1, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(300)]
    schema = "replica string, archive string, node bigint, offset bigint, end bigint, hash string"
    good = spark.createDataFrame(rows, schema)
    bad = good.withColumn("replica", F.lit("s")).withColumn("hash", F.when(F.col("node") == 77, "no").otherwise(F.col("hash")))
    levels = fixity.trees(good.unionByName(bad))
    assert [lv.count() for lv in levels] == [600, 38, 4, 2]
    for level, node in zip(levels, (77, 4, 0, 0)):
        hashes = {}
        for r in level.collect():
            hashes.setdefault(r["node"], set()).add(r["hash"])
        assert [n for n, h in hashes.items() if len(h) == 2] == [node]
    assert [tuple(r) for r in fixity.mismatches(levels, "r", "s").collect()] == [("w", 77)]


# Mixing


def slow_rake(cells, targets):
    weight = {k: float(v) for k, v in cells.items()}
    for _ in range(250):
        for d in range(3):
            sums = {}
            for k, w in weight.items():
                sums[k[d]] = sums.get(k[d], 0) + w
            total = sum(targets[d][v] for v in sums)
            weight = {k: w * targets[d][k[d]] / total / sums[k[d]] for k, w in weight.items()}
    return weight


def test_raking_matches_brute_force_and_meets_targets(spark):
    rng = random.Random(5)
    values = [[f"s{i}" for i in range(5)], ["en", "de", "(none)"], ["x", "y"]]
    cells = {(s, l, t): rng.randrange(1, 1000) for s in values[0] for l in values[1] for t in values[2] if rng.random() < 0.9}
    frame = spark.createDataFrame([(*k, float(v)) for k, v in cells.items()], "source string, lang string, topic string, base double")
    targets = [{v: rng.random() + 0.1 for v in vs} for vs in values]
    given = {d: spark.createDataFrame([*t.items(), ("absent", 9.0)], "value string, target double") for d, t in zip(mixing.DIMENSIONS, targets)}
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.rake(frame, given).collect()}
    wanted = slow_rake(cells, targets)
    assert got.keys() == wanted.keys()
    assert all(abs(got[k] - wanted[k]) < 1e-6 for k in got)
    raked = mixing.rake(frame, given)
    for share in (0.1, 0.9):
        rows = mixing.calibrate(raked, share).collect()
        assert all(0 <= r["probability"] <= 1 for r in rows)
        assert abs(sum(r["probability"] * r["base"] for r in rows) / sum(cells.values()) - share) < 1e-6


def _rake(spark, cells, targets):
    frame = spark.createDataFrame([(*k, float(v)) for k, v in cells.items()], "source string, lang string, topic string, base double")
    given = {d: spark.createDataFrame([*t.items()], "value string, target double") for d, t in zip(mixing.DIMENSIONS, targets)}
    return mixing.rake(frame, given).collect()


def test_raking_goes_on_until_the_margins_meet_or_stay(spark):
    # Nearly separate cells.
    cells = {("a", "en", "x"): 1000, ("a", "de", "x"): 1, ("b", "en", "x"): 1, ("b", "de", "x"): 1000}
    rows = _rake(spark, cells, [{"a": 0.9, "b": 0.1}, {"en": 0.5, "de": 0.5}, {"x": 1.0}])
    assert all(r["error"] <= mixing.TOLERANCE for r in rows)
    assert abs(sum(r["weight"] for r in rows if r["source"] == "a") - 0.9) < 1e-5
    # Out of reach: all of source a is English, and more of it is wanted than of English.
    del cells["a", "de", "x"]
    rows = _rake(spark, cells, [{"a": 0.7, "b": 0.3}, {"en": 0.2, "de": 0.8}, {"x": 1.0}])
    assert abs(sum(r["weight"] for r in rows if r["lang"] == "en") - 0.2) < 1e-9
    # English is then all a, so b has 0.8 in place of 0.3.
    assert all(abs(r["error"] - (0.8 / 0.3 - 1)) < 1e-3 for r in rows)


def test_zero_targets_drop_and_samples_are_stable(spark):
    rows = [(i, "word " * (i % 7 + 1), "en" if i % 3 else None, f"s{i % 4}", "clash", 1) for i in range(2_000)]
    rows += [(None, None, None, None, None, None), (5, "", "en", "s1", "c", 2), *rows[:3]]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _source string, probability int")
    targets = {"source": spark.createDataFrame([("s0", 1.0), ("s1", 1.0), ("s2", 0.0), ("s9", 5.0)], "value string, target double")}
    out = mixing.mix(frame, targets)
    assert out.columns == frame.columns
    got = [tuple(r) for r in out.collect()]
    assert {r[3] for r in got} == {"s0", "s1"}
    assert sorted(got, key=repr) == sorted((tuple(r) for r in mixing.mix(frame.repartition(5), targets).collect()), key=repr)
    words = sum(len(r[1].split()) for r in got)
    allowed = sum(len(r[1].split()) for r in rows if r[3] in ("s0", "s1"))
    assert abs(words / allowed - 0.5) < 0.06
    assert mixing.mix(frame.limit(0)).count() == 0
    cells = mixing.probabilities(frame)
    sampled = mixing.sample(frame, cells)
    assert sampled.count() == len(rows) and sampled.filter("probability IS NULL OR kept IS NULL").count() == 0


def test_tokens_are_words(spark):
    texts = [None, "", " \n ", "a", "a\tb\x0bc\x0cd\re f", " a  b ", "é\xa0ü x"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r["n"] for r in frame.select("i", mixing.tokens(F.col("text")).alias("n")).orderBy("i").collect()]
    assert got == [1, 1, 1, 1, 6, 2, 2]


# Tool calls

SCHEMAS = {
    "f": tool_calls.Schema({"n": "integer", "x": "number", "s": "string", "b": "boolean", "l": "array", "o": "object"}, frozenset({"n"})),
}
CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"


def test_arguments_are_checked_and_written_canonically(spark):
    cases = {
        "a": ('{"s": "é\\"", "n": 1}', []),
        "b": ('{"n":1,"o":{"z":1,"a":[1, 2.50]},"b":true,"l":[],"x":1e2}', []),
        "c": ("{}", ["missing n"]),
        "d": ('{"n": "1", "s": 2, "q": 0}', ["type of n", "type of s", "unexpected q"]),
        "e": ("{nope", ["malformed"]),
        "f": (None, ["malformed"]),
        "g": ("[1]", ["malformed"]),
        "h": ('{"n":1,"n":2}', ["malformed"]),
        "i": ('{"n":null,"x":null}', ["missing n"]),
        "j": ('{"n":1.5}', ["type of n"]),
    }
    calls = [(1, k, i, "f", a, None) for i, (k, (a, _)) in enumerate(cases.items())] + [(1, "u", 99, "g", "{}", [])]
    results = [(1, "a", 5, "later"), (1, "a", 3, 'first "line"\n'), (1, "a", 3, 'first "line"\n'), (1, "zz", 1, "orphan"), (2, "b", 1, "elsewhere")]
    out = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    rows = {r["call_id"]: r for r in out.collect()}
    assert {k: r["errors"] for k, r in rows.items()} == {k: e for k, (_, e) in cases.items()} | {"u": ["unknown tool"]}
    assert rows["a"]["status"] == "ok" and rows["b"]["status"] == "unanswered" and rows["c"]["status"] == "invalid"
    assert rows["a"]["json"] == '{"arguments":{"n":1,"s":"é\\""},"id":"a","name":"f","result":"first \\"line\\"\\n"}'
    parsed = json.loads(rows["b"]["json"])
    assert parsed["arguments"]["o"] == {"z": 1, "a": [1, 2.5]} and parsed["result"] is None
    assert list(parsed["arguments"]) == sorted(parsed["arguments"]) and " " not in rows["b"]["json"]


def test_order_follows_dependencies(spark):
    rng = random.Random(7)
    calls = []
    for conv in range(12):
        n = 40 if conv else 400
        order = list(range(n))
        rng.shuffle(order)
        for place, i in enumerate(order):
            needs = [f"c{order[rng.randrange(place)]}" for _ in range(rng.randrange(3)) if place]
            if not conv:
                needs = [f"c{i - 1}"] if i else []
            calls.append((conv, f"c{i}", rng.randrange(n) if conv else i, "f", '{"n":1}', [*needs, "unknown", None]))
    rng.shuffle(calls)
    frame = spark.createDataFrame([*calls, *calls[:5], (None, "c1", 1, "f", "{}", None), (3, None, 1, "f", "{}", None)], CALLS)
    rows = tool_calls.link(frame, spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    place = {(r["conv_id"], r["call_id"]): r["position"] for r in rows}
    assert len(rows) == len(calls) and {r["status"] for r in rows} == {"unanswered"}
    for conv, call, _, _, _, needs in calls:
        assert all(place[conv, d] < place[conv, call] for d in needs if d and d != "unknown")
    for conv in range(12):
        assert sorted(p for (c, _), p in place.items() if c == conv) == list(range(40 if conv else 400))
    turns = {(c, i): t for c, i, t, *_ in calls}
    moment = {}
    for conv, call, turn, _, _, _ in calls:
        seen, todo = set(), [call]
        by = {c[1]: c[5] for c in calls if c[0] == conv}
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [d for d in by[x] if d in by]
        moment[conv, call] = max(turns[conv, x] for x in seen)
    for conv in range(12):
        ranked = sorted((c for c in place if c[0] == conv), key=place.get)
        assert [moment[c] for c in ranked] == sorted(moment[c] for c in ranked)


def test_cycles_are_reported_and_come_last(spark):
    calls = [(1, "a", 1, "f", '{"n":1}', ["b"]), (1, "b", 2, "f", '{"n":1}', ["a"]), (1, "c", 2, "f", '{"n":1}', ["a"]), (1, "d", None, "f", '{"n":1}', ["d"]), (1, "e", 2, "f", '{"n":1}', [])]
    out = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS)
    rows = {r["call_id"]: (r["position"], r["status"]) for r in out.collect()}
    assert rows == {"d": (0, "cycle"), "e": (1, "unanswered"), "a": (2, "cycle"), "b": (3, "cycle"), "c": (4, "cycle")}
    empty = tool_calls.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS)
    assert empty.count() == 0


def test_numpy_is_not_needed_for_native_operators():
    assert np.__name__ not in vars(url_filter) and "np" not in vars(fixity)
