import collections
import hashlib
import random
import re
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stockloom.llm import bpe, fingerprints, license_scan, order

PATH = public_tokenizers.path("word_bpe_49k.json")


# Licences


def slow_matches(text, templates, threshold):
    text = re.sub(r"[^a-z0-9\n]+", " ", (text or "").lower())
    flat = lambda u: " ".join(u.split())
    units = {flat(u) for u in [*text.split("\n"), *re.split(r"\n *\n", text), text]}
    found = []
    for unit in units:
        words = unit.split(" ")
        a = set(zip(words, words[1:]))
        for name, wording in templates.items():
            b = {tuple(p.split(" ")) for p in license_scan.template_bigrams(wording)}
            if a and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                found.append((-2 * len(a & b) / (len(a) + len(b)), name))
    return sorted(found)


def test_license_scan_matches_unpruned_search(spark):
    rng = random.Random(8)
    templates = license_scan.TEMPLATES
    texts = [None, "", "\n\n", "one", "All rights\nreserved.", "under " * 60_000]
    for wording in templates.values():
        words = wording.split()
        for _ in range(6):
            changed = [w if rng.random() > 0.12 else rng.choice(["x", w + " y", ""]) for w in words]
            lines = "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in changed)
            texts.append(rng.choice(["", "before\n", "before\n\n"]) + lines + rng.choice(["", "\nafter it", "\n \nafter it"]))
            texts.append("Some line\n" + " ".join(changed).upper() + "\nend")
    texts.append("\n".join(templates.values()))
    rows = [(i, t, "mine", "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, dice string, _found string")
    for threshold in (0.8, 0.95):
        out = license_scan.scan(frame, threshold=threshold)
        assert out.columns == ["doc_id", "text", "_found", "license", "dice", "n_matches", "licenses"]
        hits = 0
        for r in out.collect():
            wanted = slow_matches(texts[r["doc_id"]], templates, threshold)
            hits += bool(wanted)
            assert r["n_matches"] == len(wanted)
            assert r["licenses"] == sorted({n for _, n in wanted})
            assert (r["license"], r["dice"]) == ((wanted[0][1], -wanted[0][0]) if wanted else (None, None))
        assert hits > 20
    assert license_scan.scan(frame.limit(0)).count() == 0


# Byte-pair encoding


def merged_states(words):
    """States of the smallest automaton: different sets of endings."""
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)} | {b""}
    return len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def test_lexicon_is_minimal_and_addresses_ids(tmp_path):
    rng = random.Random(9)
    words = {bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randrange(1, 7))) for _ in range(150)}
    entries = {w: [rng.randrange(1000) for _ in range(rng.randrange(4))] for w in words}
    lexicon = bpe.Lexicon.build(sorted(entries.items()))
    assert len(lexicon.final) == merged_states(words)
    lexicon.save(str(tmp_path / "lexicon"))
    lexicon = bpe.Lexicon.load(str(tmp_path / "lexicon"))
    assert isinstance(lexicon.keys, np.memmap)
    asked = [*words, b"", b"zzz", b"abcabcabc", b"x" * 100, *(w + b"a" for w in words)]
    for word, rank in zip(asked, lexicon.ranks(asked).tolist()):
        got = lexicon.ids[lexicon.starts[rank] : lexicon.starts[rank + 1]].tolist() if rank >= 0 else None
        assert got == entries.get(word)
    empty = bpe.Lexicon.build([])
    empty.save(str(tmp_path / "empty"))
    assert bpe.Lexicon.load(str(tmp_path / "empty")).ranks([b"a", b""]).tolist() == [-1, -1]


def test_all_combining_marks_equal_the_library():
    with open(PATH) as file:
        vocabulary = bpe.Vocabulary(file.read())
    library = Tokenizer.from_file(PATH)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))] + ["\U00011930", "\U00011935\U00011930", "\U00011938"]
    shapes = ["a{}\u0301", "a\u0301{}", "a{}\u0323", "a\u0345{}\u0300", "{}e\u0304{}\u0316x", "{}"]
    texts = [shape.format(mark, mark) for mark in marks for shape in shapes]
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert vocabulary.word(text.encode()) == wanted.ids, ascii(text)


ODD = [
    None, "", "  \n\t ", "İ? ΑΣ σς ǅ ß ﬁ ½²٣ 漢字 😀‍x", "we're i'll 'sS it'S", "a<|endoftext|>b <|startoftext|> <|EndOfText|>",
    "x" * 5_000 + " " + "ab" * 400, "e\u0301te\u0301 e\u0301", "no\xa0break\u3000wide\x85next\x1cend", "!!??--__ 12345 1a2b", "\u0558\ua7dc\u1c89 \U00010d50",
]


def test_encoding_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "FREQUENT_WORDS", 50)
    library = Tokenizer.from_file(PATH)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(10)
    alphabet = "aAbB ΣσςİIı\u0307ßéÉ 'sStTll,.!?1²½٣<|>漢😀\t\n_-\xa0"
    texts += ODD + ["".join(rng.choices(alphabet, k=30)) for _ in range(300)]
    rows = [(i, t, "mine", 1.5) for i, t in enumerate(texts)] + [(0, texts[0], "again", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded double")
    out = bpe.decode(bpe.encode(frame, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        wanted = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == wanted
        assert r["decoded"] == library.decode(wanted, skip_special_tokens=False)
    assert bpe.encode(frame.limit(0), PATH).count() == 0


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    with open(PATH) as file:
        text = file.read()
    encoder = bpe.Encoder(bpe.Vocabulary(text), bpe.Lexicon.build([]))
    for block in (["some words here", "and some more"], ["some words"], ["", None], ["here and there"]):
        wanted = [bpe.Vocabulary(text).word(t.encode()) if t and " " not in t else None for t in block]
        got = encoder(block)[0].to_pylist()
        assert all(w is None or g == w for g, w in zip(got, wanted))
        assert got == [sum((bpe.Vocabulary(text).word(w.encode()) for w in (t or "").split()), []) for t in block]


def test_decoding_of_odd_ids(spark):
    frame = spark.createDataFrame([([320, None, -1, 10**6, 49407],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(frame, PATH).collect()] in (["a</w> <|endoftext|>", "", ""], ["a</w> <|endoftext|>", None, ""])


# Fingerprints


def jaccard(a, b):
    a, b = (collections.Counter((t or "").split()) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard(monkeypatch):
    monkeypatch.setattr(fingerprints, "SAMPLES", 2048)
    rng = random.Random(11)
    sampler = fingerprints.Sampler()
    for share in (0.2, 0.6, 0.9):
        a = [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(60)]
        b = [w if rng.random() < share else rng.choice("klmnop") for w in a]
        x, y = sampler([" ".join(a), " ".join(b)])
        assert abs(fingerprints.likeness(x, y) - jaccard(" ".join(a), " ".join(b))) < 0.05


def test_equal_texts_have_equal_fingerprints_in_any_block(words):
    texts = [words(i, 80) for i in range(6)] + ["", None, "one"]
    together = fingerprints.Sampler()(texts + texts[::-1])
    alone = np.concatenate([fingerprints.Sampler()([t]) for t in texts])
    assert (together[: len(texts)] == alone).all() and (together[len(texts) :] == alone[::-1]).all()
    assert not together[6].any() and not together[7].any() and together[8].any()


def test_quantiles_have_the_moments_of_the_distribution():
    q = fingerprints.gamma_quantiles()
    assert abs(q.mean() - 2) < 0.01 and abs(q.var() - 2) < 0.05 and (np.diff(q) > 0).all()


@pytest.mark.parametrize("kind", ["dense", "gaps", "few", "one", "ties", "none"])
def test_next_row(spark, kind):
    rng = random.Random(12)
    ids = {
        "dense": list(range(500)), "gaps": [rng.randrange(-(10**15), 10**15) for _ in range(300)], "few": [5, 1, 9],
        "one": [7], "ties": [1] * 150 + [2] * 50 + [None] * 30 + list(range(5, 50)), "none": [],
    }[kind]
    rows = [(i, f"t{rng.randrange(10**6)}", "x") for i in ids]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k bigint, text string, _bucket string").repartition(7)
    out = order.with_next(frame, "k", "text", {"text": "after"})
    assert out.columns == ["k", "text", "_bucket", "after"]
    ranked = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    wanted = [(*r, n[1]) for r, n in zip(ranked, [*ranked[1:], *ranked[:1]])]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(wanted, key=repr)


def test_fingerprint_query_on_planted_rows(spark, tmp_path):
    from stockloom.llm.queries import QUERIES

    texts = ["a b c d e f 😀", "a b c d e f 😀", None, "", "x y", "p q r s t u v w " * 50]
    frame = spark.createDataFrame([(10 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op6_weighted_fingerprints"](spark, str(tmp_path)).orderBy("doc_id", ascending=False).collect()
    for i, r in enumerate(rows):
        own, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and rows[0]["near_next"] == 1.0
    assert rows[2]["near_next"] == 1.0 and rows[3]["fingerprint"] == "0" * 4 * fingerprints.SAMPLES
