"""Conversation repair, vector codes and partial matching against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stockloom.llm import conversations, partial_matching, vector_codes
from stockloom.llm.queries import QUERIES

# Conversation repair


def slow_edits(kinds):
    """Cost and initials of the best edits, by trying all of them."""

    def walk(at, state, edits, cost):
        # More insertions between rows would add a pair that changes nothing.
        if cost > 4 * len(kinds) + 7:
            return
        if at == len(kinds) and state in (0, 3):
            found.append((cost, edits))
        tail = len(edits) - len(edits.rstrip("I"))
        if tail < 3:
            walk(at, {0: 2, 1: 2, 2: 3, 3: 2}[state], edits + "I", cost + 3)
        if at < len(kinds):
            initial, fault = kinds[at]
            walk(at + 1, state, edits + "D", cost + 4)
            if fault != "go":
                extra = 3 if fault == "cut" else 0
                after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                walk(at + 1, after, edits + "R", cost + 3 + extra)
                if initial == "s" and state == 0:
                    walk(at + 1, 1, edits + "K", cost + extra)
                elif initial and initial == "_sua"[after]:
                    walk(at + 1, after, edits + "K", cost + extra)

    found = []
    walk(0, 0, "", 0)
    return min(found)


def streamed(kinds):
    state, cost, links = conversations.START, 0, bytearray()
    for kind in kinds:
        state, lowest, link = conversations.advance(state, conversations.KINDS.index(kind))
        cost += lowest
        links += link
    more, end, tail = conversations.finish(state)
    edits, first = conversations.edits_of(bytes(links), end)
    assert first == conversations.EMPTY
    return cost + more, "".join(edits) + tail


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(11)
    kinds = conversations.KINDS
    for size in range(4):
        for _ in range(1 if size == 0 else 60):
            some = [rng.choice(kinds) for _ in range(size)]
            assert streamed(some) == slow_edits(some), some
    usual = [("s", "ok"), ("u", "ok"), ("a", "ok"), ("u", "cut"), ("a", "go"), ("", "ok")]
    for _ in range(25):
        some = [rng.choice(usual) for _ in range(4)]
        assert streamed(some) == slow_edits(some), some


def slow_repair(rows):
    """Counts, edits and hash of one conversation from its rows (turn, role, text), all edits by a plain program."""
    rows = sorted(
        ((t, r or " ", " " if x is None else x) for t, r, x in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()),
    )
    seen, kinds, faults, illegal = set(), [], Counter(), 0
    for at, (_, role, text) in enumerate(rows):
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        kinds.append((role[0] if role[0] in "sua" else "", "go" if fault in ("blank", "duplicate") else "cut" if fault else "ok"))
        illegal += at > 0 and rows[at - 1][1][0] + role[0] not in ("su", "ua", "au")
    # The best way to each state after each row, with its edits and turns as they are.
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    every = [(0, 0, "", ())]
    for (turn, role, text), (initial, fault) in zip(rows, kinds):
        more = []
        for s, c, e, out in every:
            for k in range(3):
                more.append((s, c + 4, e + "D", out))
                if fault != "go":
                    extra = 3 if fault == "cut" else 0
                    name = "user" if step[s] == 2 else "assistant"
                    more.append((step[s], c + 3 + extra, e + "R", (*out, (name, text))))
                    if initial == "s" and s == 0:
                        more.append((1, c + extra, e + "K", (*out, (role, text))))
                    elif initial and initial == "_sua"[step[s]]:
                        more.append((step[s], c + extra, e + "K", (*out, (role, text))))
                s, c, e, out = step[s], c + 3, e + "I", (*out, ("user" if step[s] == 2 else "assistant", ""))
        least = {}
        for s, c, e, out in more:
            least[s] = min((c, e, out), least.get(s, (c, e, out)))
        every = [(s, *w) for s, w in least.items()]
    ends = []
    for s, c, e, out in every:
        while s not in (0, 3):
            out, s, c, e = (*out, ("user" if step[s] == 2 else "assistant", "")), step[s], c + 3, e + "I"
        ends.append((c, e, out))
    cost, audit, out = min(ends)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest


SCHEMA = "conv_id bigint, turn bigint, role string, text string"
DIGEST = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def some_conversations(seed, n, longest=9):
    rng = random.Random(seed)
    texts = ["Hello.", "Why?", "cut off", "", " \n", "Yes!  \n", "é. x", None, "same.", "same."]
    return [
        (c if c else None, rng.choice([None, *range(6), t]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "upper"]), rng.choice(texts))
        for c in range(n)
        for t in range(rng.randrange(1, longest))
    ]


@pytest.mark.parametrize("rows, size", [(4096, 1 << 22), (1, 1 << 20), (3, 12)])
def test_conversations_equal_a_plain_program(spark, rows, size):
    data = some_conversations(3, 60)
    data += [(500, t, "user" if t % 3 else "assistant", f"text {t}" + "." * (t % 2)) for t in range(300)]
    data.append((501, 0, "user", "long " * 200_000))
    frame = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS part", "'x' AS name")
    by = defaultdict(list)
    for c, *row in data:
        by[c].append(row)
    found = conversations.digests(conversations.repair(frame, rows, size)).collect()
    assert len(found) == len(by)
    for r in found:
        wanted = slow_repair(by[r["conv_id"]])
        if any(r_ == "" for _, r_, _ in by[r["conv_id"]]):
            continue
        assert tuple(r[c] for c in DIGEST) == wanted, by[r["conv_id"]]


def test_repaired_conversations_are_regular(spark):
    frame = spark.createDataFrame(some_conversations(5, 80), SCHEMA)
    for r in conversations.repair(frame).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in r["roles"])) is not None
        assert len(r["roles"]) == len(r["texts"]) == len(r["audit"].replace("D", ""))
    assert conversations.digests(conversations.repair(frame.limit(0))).count() == 0


def test_damaged_conversations_of_the_query(spark, tmp_path):
    data = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}.") for c in range(40) for t in range(6)]
    data += [(None, None, None, None), (1000, 0, "user", "x")]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    by = defaultdict(list)
    for c, t, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        damage = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if damage == 1 else text.translate({ord(x): None for x in ".!?"}) if damage == 2 else text
        by[c] += [(t, "user" if damage == 4 else role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
    found = {r["conv_id"]: r for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert set(found) == {c for c, *_ in data}
    for c, r in found.items():
        nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert tuple(r[x] for x in DIGEST) == (slow_repair(by[c]) if by[c] else nothing)


# Vector codes


def slow_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for i, g in groups.items():
                books[p][i] = [sum(column) // len(g) for column in zip(*g)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=repr)


def vectors(seed, n, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(n + i, list(centres[0]), 7) for i in range(n // 2)]  # a vector of many rows
    rows = [(i, [x * scale for x in v], label) for i, v, label in rows]
    return rows + [(n * 2, None, 1), (n * 2 + 1, [None] * 8, 1), (n * 2 + 2, [float("nan")] * 8, 1), (n * 2 + 3, [float("-inf")] * 8, 1), (3, [0.5 * scale] * 8, 1)]


@pytest.mark.parametrize("n, scale", [(700, 1.0), (5, 1.0), (300, 1e30)])
def test_codes_equal_plain_rounds(spark, tmp_path, n, scale):
    rows = vectors(n, n, scale)
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    frame.selectExpr("*", "'x' AS code", "1 AS id").write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted = slow_codes(rows)
    if scale > 1:  # beyond a long
        wanted = [(i, c, min(e, (1 << 63) - 1), None, d) for i, c, e, _, d in wanted]
    found = QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect()
    got = sorted(((*r[:3], r[3] if scale == 1 else None, r[4]) for r in found), key=repr)
    assert got == wanted


def test_bounds_settle_whole_nodes_of_clustered_parts():
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (256, 4)).astype(float)
    points = np.repeat(centres[:32], 512, 0) + rng.integers(-3, 4, (32 * 512, 4))
    order = vector_codes.Tree.order_of(points, vector_codes.LEAF)
    tree = vector_codes.Tree.over(points[order], order, vector_codes.LEAF)
    nearest, counts, sums, settled = vector_codes.assign(tree, centres)
    slow = ((points[order][:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (nearest == slow).all() and (counts == np.bincount(slow, minlength=256)).all()
    assert all((sums[e] == points[order][slow == e].sum(0)).all() for e in range(256))
    assert settled["whole"] > len(points) / 2 and settled["distances"] < len(points) * 256 / 10


# Partial matching


def slow_scores(rows, order=5, d=0.5):
    """Probabilities from nested dictionaries, symbols excluded one by one."""
    low = lambda t: (t or "").encode().lower()
    learn = [low(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    trie = defaultdict(Counter)
    for text in learn:
        symbols = [257] * order + list(text) + [256]
        for at in range(order, len(symbols)):
            for k in range(order + 1):
                trie[tuple(symbols[at - k : at])][symbols[at]] += 1
    words = Counter(w for t in learn for w in [*t.split(), None])
    total, kinds = sum(words.values()), len(words)

    def log_p(context, symbol):
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            seen = {s: n for s, n in trie.get(tuple(context[order - k :]), {}).items() if s not in excluded}
            if seen:
                everything = sum(seen.values())
                if symbol in seen:
                    return out + math.log10((seen[symbol] - d) / everything)
                out += math.log10(d * len(seen) / everything)
                excluded |= set(seen)
        return out - math.log10(257 - len(excluded))

    for i, text in rows:
        text = low(text)
        symbols = [257] * order + list(text) + [256]
        score = sum(log_p(symbols[at - order : at], symbols[at]) for at in range(order, len(symbols)))
        tokens = [*text.split(), None]
        base = sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in tokens)
        yield i, len(tokens), sum(words[w] > 0 for w in tokens), total, base, score


def test_scores_equal_a_plain_trie(spark, monkeypatch):
    rng = random.Random(13)
    texts = ["", None, " \n", "A b\tc", "ünïcode Text 漢字", "the cat sat on the mat " * 30, "x" * 3000, "w" * 50 + " z"]
    texts += [" ".join(rng.choice(["the", "cat", "Sat", "on", "mats", "über", "q"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "nameless text"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS gram", "'x' AS word", "0 AS n").repartition(3)
    found = partial_matching.score(frame).collect()
    key = lambda r: tuple(repr(x) if not isinstance(x, float) else f"{x:.6f}" for x in r)
    got = sorted(key((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])) for r in found)
    assert got == sorted(map(key, slow_scores(rows)))
    assert partial_matching.score(frame.limit(0)).count() == 0
    only = partial_matching.score(spark.createDataFrame([(i, "ab") for i in range(60)], "doc_id bigint, text string").filter(partial_matching.held_out()))
    assert all(abs(r["score"] + 3 * math.log10(257)) < 1e-9 for r in only.collect())
    # Small blocks and pieces change nothing; they are read inside the tasks.
    assert sum(map(len, partial_matching.grams_of(b"x" * 2500, 5))) == 2501


def test_probabilities_of_a_context_add_up(spark):
    text = "abracadabra banana"
    contexts = [text[i : i + 5].encode() for i in range(4)] + [b"zzzzz", b"zzabr"]
    rows = []
    for c in contexts:
        for s in [*range(256), 256]:
            gram = 0
            for x in [*c, s]:
                gram = gram << 9 | x
            rows.append((gram, 0))
    for piece in partial_matching.grams_of(text.encode(), 5):
        rows += [(int(g), 1) for g in piece]
    counts = spark.createDataFrame(rows, "gram bigint, n bigint").groupBy("gram").sum("n").toDF("gram", "n")
    sums = Counter()
    for r in partial_matching.log_probabilities(counts).collect():
        sums[r["gram"] >> 9] += 10 ** r["log_p"]
    for c in contexts:
        packed = 0
        for x in c:
            packed = packed << 9 | x
        assert abs(sums[packed] - 1) < 1e-9
