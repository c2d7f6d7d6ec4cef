"""BPE encoding and decoding with a minimal acyclic transducer of the corpus's frequent words.

All words (runs without ASCII white space) of the corpus are counted; the ``FREQUENT_WORDS`` most frequent
ones are encoded once and compiled into a minimal acyclic automaton with shared suffixes, whose
transitions carry numbers that add up to the word's rank; the rank addresses its token ids. The file is
sent to the executors with ``addFile`` and memory-mapped by their Python workers. Other words are
merged exactly by the vocabulary's ranks, so results never depend on which words are frequent.

Only vocabularies of the kind of ``Vocabulary`` are handled: normaliser NFC, white space to one space, lower
case; a pattern that cuts pieces; byte-level symbols; merges by rank with a suffix that ends words.
White space separates pieces and gives no token, so words are encoded independently.

Defined cases: null or blank text has no tokens and decodes to the empty text; special tokens in a text
become their ids, as without special-token parsing being switched off; repeated rows, ties in the
word counts and extra columns change nothing. Invalid ids in ``decode`` are left out, null ids too.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.arrow import split_words, with_columns
from stockloom.operators.scans import materialize

#: Words in the lexicon, at most, and the longest of them in bytes.
FREQUENT_WORDS, LONGEST_WORD = 200_000, 48
#: Classes of word counts for each doubling.
CLASSES = 8
#: Bytes, about, of the words and of the pieces whose ids a worker remembers between blocks.
REMEMBERED = 32 << 20
#: Bytes of an entry besides its word and ids.
_ENTRY = 160
#: Pieces of more symbols are merged with a heap.
_LONG = 64
_SHIFT = 20
_NONE = 1 << 62

# Fixed values, equal to the vocabulary's library: code points assigned after Unicode 16 (first, last), which
# count as signs when text is cut, and capitals assigned after Unicode 15 (first, last, distance to the small letter).
_AFTER_16 = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20),
    (0x16EA0, 0x16EB8, 0x1B),
)
# Combining marks and one pair that the vocabulary's library does not know yet (first, last); they are
# neither reordered nor composed there.
_UNKNOWN_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA),
    (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11938, 0x11938), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
_MARKS = regex.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _UNKNOWN_MARKS) + "])")
_NEWER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _AFTER_16) + "]")
_LATE = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in _CAPITALS) + "]")
_LOWER = {c: c + d for a, b, d in _CAPITALS for c in range(a, b + 1)}


def byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes: itself if printable, else the next character from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _letters(text: str) -> str | None:
    """The normalised text if it is, before and after, nothing but letters; else null."""
    if not text.isalpha():
        return None
    lower = text.lower()
    if text.isascii() or lower.isalpha() and "Σ" not in text and unicodedata.is_normalized("NFC", text):
        return lower
    return None


def compose(text: str) -> str:
    """Canonical composition as the vocabulary's library does it: marks unknown there separate what is composed."""
    if text.isascii() or not _MARKS.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", part) for part in _MARKS.split(text))


class Vocabulary:
    """Merges, symbols and special tokens of a vocabulary file, and the exact encoding of one word."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or data["decoder"] is not None:
            raise ValueError("not a vocabulary of this kind")
        ids: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.inner = [ids[c] for c in byte_symbols()]
        self.last = [ids[c + end] for c in byte_symbols()]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a] << _SHIFT | ids[b]] = rank << _SHIFT | ids[a + b]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, number in (ids | self.special).items():
            self.tokens[number] = token
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, array] = {}
        self.known_bytes = 0

    def word(self, word: bytes) -> list[int]:
        """Token ids of a run without ASCII white space."""
        text = word.decode("utf-8", "surrogatepass")
        # Most words are letters, perhaps with one sign after them; no pattern is needed to cut these.
        if (letters := _letters(text)) is not None:
            return self.piece(letters)
        if text[-1] in ",.!;:?" and (letters := _letters(text[:-1])) is not None:
            return self.piece(letters) + self.piece(text[-1])
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self.special_pattern.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        # Lower case of each character by itself: a sigma stays the same at the end of a word.
        text = compose(text).replace("Σ", "σ").lower()
        if _LATE.search(text):
            text = text.translate(_LOWER)
        out: list[int] = []
        for piece in self.pieces(text) if text.isascii() or not _NEWER.search(text) else self._assigned_pieces(text):
            out += self.piece(piece)
        return out

    def piece(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is not None:
            return ids.tolist()
        found = self.merge(piece.encode("utf-8", "surrogatepass"))
        self.known[piece] = array("i", found)
        self.known_bytes += _ENTRY + len(piece) + 4 * len(found)
        return found

    def _assigned_pieces(self, text: str) -> list[str]:
        """Pieces where characters newer than the vocabulary's library count as signs, as they do there."""
        proxy = _NEWER.sub("\ue000", text)
        pieces, at = [], 0
        for piece in self.pieces(proxy):
            at = proxy.index(piece, at)
            pieces.append(text[at : at + len(piece)])
            at += len(piece)
        return pieces

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of the lowest rank, the leftmost first, until none is left."""
        ids = [self.inner[b] for b in piece[:-1]]
        ids.append(self.last[piece[-1]])
        if len(ids) > _LONG:
            return self._merge_long(ids)
        get, low_bits = self.merges.get, (1 << _SHIFT) - 1
        ranks = [get(a << _SHIFT | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != _NONE:
            i = ranks.index(low)
            ids[i] = low & low_bits
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _SHIFT | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << _SHIFT | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long pieces: a heap of pairs, and links to the neighbours that are left."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << _SHIFT | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << _SHIFT | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank & ((1 << _SHIFT) - 1), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] >= 0 and (r := get(ids[at] << _SHIFT | ids[after[at]])) is not None:
                    heapq.heappush(heap, (r, at))
        return [x for x in ids if x >= 0]


@dataclass(frozen=True)
class Lexicon:
    """Minimal acyclic transducer over bytes, as arrays that can be memory-mapped.

    A transition is found by ``state * 256 + byte`` among the sorted ``keys``; ``adds`` of the transitions
    of a word add up to its rank in byte order; ``ids[starts[rank]:starts[rank + 1]]`` are its tokens.
    """

    keys: np.ndarray
    targets: np.ndarray
    adds: np.ndarray
    final: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    root: int

    @staticmethod
    def build(entries: Iterable[tuple[bytes, list[int]]]) -> Lexicon:
        """Compile distinct words, given in byte order, with their ids; equal suffixes are shared at once."""
        keys, targets, adds, final = array("q"), array("i"), array("i"), array("B")
        words_from = array("i")  # of each state, how many words can still be read
        lengths, all_ids = array("i"), array("i")
        register: dict[bytes, int] = {}
        # Open states along the last word: whether it ends a word, and (byte, state) of its closed children.
        path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]

        def close(ends: bool, children: list[tuple[int, int]]) -> int:
            signature = bytes([ends]) + b"".join(b"%c%d," % child for child in children)
            state = register.get(signature)
            if state is None:
                state = register[signature] = len(final)
                final.append(ends)
                reach = int(ends)
                for byte, child in children:
                    keys.append(state * 256 + byte)
                    targets.append(child)
                    adds.append(reach)
                    reach += words_from[child]
                words_from.append(reach)
            return state

        def close_below(depth: int, word: bytes) -> None:
            while len(path) - 1 > depth:
                ends, children = path.pop()
                path[-1][1].append((word[len(path) - 1], close(ends[0], children)))

        last = b""
        for word, ids in entries:
            lengths.append(len(ids))
            all_ids.extend(ids)
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close_below(common, last)
            path += [([False], []) for _ in word[common:]]
            path[-1][0][0] = True
            last = word
        close_below(0, last)
        root = close(path[0][0][0], path[0][1])
        return Lexicon(
            np.array(keys, np.int64),
            np.array(targets, np.int32),
            np.array(adds, np.int32),
            np.array(final, np.uint8),
            np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype(np.int64),
            np.array(all_ids, np.int32),
            root,
        )

    def save(self, path: str) -> None:
        """One file: a line of lengths, then the arrays at places divisible by eight."""
        arrays = [self.keys, self.starts, self.targets, self.adds, self.ids, self.final]
        with open(path, "wb") as file:
            file.write(json.dumps([self.root, *map(len, arrays)]).encode().ljust(256))
            for array in arrays:
                file.write(array.tobytes())
                file.write(b"\0" * (-array.nbytes % 8))

    @staticmethod
    def load(path: str) -> Lexicon:
        with open(path, "rb") as file:
            root, *lengths = json.loads(file.read(256))
        at, arrays = 256, []
        for n, kind in zip(lengths, (np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8)):
            arrays.append(np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind))
            at += arrays[-1].nbytes + -arrays[-1].nbytes % 8
        keys, starts, targets, adds, ids, final = arrays
        return Lexicon(keys, targets, adds, final, starts, ids, root)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for words that are not in the lexicon. All words advance together."""
        lengths = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(lengths) - lengths
        rank = np.zeros(len(words), np.int64)
        state = np.full(len(words), self.root, np.int64)
        lost = (lengths > LONGEST_WORD) | (len(self.keys) == 0)
        for step in range(int(lengths[~lost].max(initial=0))):
            on = np.nonzero(~lost & (lengths > step))[0]
            key = state[on] * 256 + letters[begins[on] + step]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[place] == key
            lost[on[~found]] = True
            on, place = on[found], place[found]
            rank[on] += self.adds[place]
            state[on] = self.targets[place]
        return np.where(lost | (self.final[state] == 0), -1, rank)


def _spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Encodes blocks of texts in one task; remembers the ids of words within a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.begins, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.vocabulary.forget()

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of new words: those of the lexicon from its file, the others by merging."""
        ranks = self.lexicon.ranks(words)
        missed = np.nonzero(ranks < 0)[0]
        merged = [self.vocabulary.word(words[i]) for i in missed.tolist()]
        hits = np.nonzero(ranks >= 0)[0]
        starts = self.lexicon.starts[ranks[hits]]
        lengths = np.zeros(len(words), np.int64)
        lengths[hits] = self.lexicon.starts[ranks[hits] + 1] - starts
        lengths[missed] = np.fromiter(map(len, merged), np.int64, len(merged))
        begins = self.used + np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        if self.used + total > len(self.ids):
            larger = np.zeros(max(2 * len(self.ids), self.used + total), np.int32)
            larger[: self.used] = self.ids[: self.used]
            self.ids = larger
        # Only the ids of words that were found are read from the mapped file.
        self.ids[_spans(begins[hits], lengths[hits])] = self.lexicon.ids[_spans(starts, lengths[hits])]
        self.ids[_spans(begins[missed], lengths[missed])] = np.fromiter(chain.from_iterable(merged), np.int32)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.begins = np.concatenate([self.begins, begins])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += total
        self.held += _ENTRY * len(words) + sum(map(len, words)) + 4 * total

    def __call__(self, texts: list[str | None]) -> list[pa.Array]:
        words = [split_words(t) for t in texts]
        if self.held > REMEMBERED or self.vocabulary.known_bytes > REMEMBERED:
            self.forget()
        unknown = set().union(*words).difference(self.number)
        if unknown:
            self.learn(list(unknown))
        counts = np.array([len(w) for w in words], np.int64)
        place = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        lengths = self.lengths[place]
        ends = np.cumsum(lengths)
        values = self.ids[_spans(self.begins[place], lengths)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))]


def frequent_words(documents: DataFrame) -> DataFrame:
    """``word`` of the most frequent words of all documents, at most ``FREQUENT_WORDS``.

    Counts fall into classes, ``CLASSES`` for each doubling; the highest classes that fit are taken whole.
    Only the sizes of the classes reach the driver, and no task ranks the words of all others.
    """
    words = documents.select(F.explode(F.split("text", "[ \\t-\\r]+")).alias("word"))
    counted = words.filter((F.octet_length("word") > 0) & (F.octet_length("word") <= LONGEST_WORD))
    class_of = F.floor(F.log2(F.count(F.lit(1))) * CLASSES).cast("int").alias("class")
    counts = materialize(counted.groupBy("word").agg(class_of))
    sizes = sorted(((r["class"], r["count"]) for r in counts.groupBy("class").count().collect()), reverse=True)
    taken, lowest = 0, None
    for class_, size in sizes:
        taken += size
        if taken > FREQUENT_WORDS:
            break
        lowest = class_
    return counts.filter(F.col("class") >= F.lit(lowest)).select("word")


def build_lexicon(documents: DataFrame, vocabulary: str) -> Lexicon:
    """Count the corpus, encode its frequent words on the executors and compile them.

    At most ``FREQUENT_WORDS`` words with their ids reach the driver.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each batch: its words joined by spaces, and their ids."""
        word = Vocabulary(shared.value).word
        for batch in batches:
            words = [w.encode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
            ids = [word(w) for w in words]
            lengths = np.array([len(x) for x in ids], np.int32).tobytes()
            flat = np.array([i for x in ids for i in x], np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(words)]), pa.array([lengths]), pa.array([flat])], names=names)

    names = ["words", "lengths", "ids"]
    ordered = frequent_words(documents).orderBy("word")
    rows = ordered.mapInArrow(encoded, "words binary, lengths binary, ids binary").collect()

    def entries() -> Iterator[tuple[bytes, list[int]]]:
        for row in rows:
            at, ids = 0, np.frombuffer(row["ids"], np.int32)
            for word, n in zip(bytes(row["words"]).split(b" "), np.frombuffer(row["lengths"], np.int32).tolist()):
                yield word, ids[at : at + n].tolist()
                at += n

    return Lexicon.build(entries())


def encode(documents: DataFrame, vocabulary_path: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array of int). Reads the vocabulary file on the driver and the corpus twice."""
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    context = documents.sparkSession.sparkContext
    # Spark copies the file to every executor, also to those that start later.
    staged = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), f"lexicon-{uuid.uuid4().hex}")
    build_lexicon(documents, vocabulary).save(staged)
    context.addFile(staged)
    name, shared = os.path.basename(staged), context.broadcast(vocabulary)

    def make():
        return Encoder(Vocabulary(shared.value), Lexicon.load(SparkFiles.get(name)))

    return with_columns(documents, ["text"], make, [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], keep)


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """Add ``decoded``: the tokens of ``ids``, special ones included, joined by one space."""
    with open(vocabulary_path, encoding="utf-8") as file:
        tokens = Vocabulary(file.read()).tokens
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    schema = T.StructType([f for f in encoded.schema if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column(part.schema.get_field_index("ids"))
                values, offsets = ids.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0))])
                known = pc.fill_null(pc.and_(pc.greater_equal(values, 0), pc.less(values, len(names))), False)
                if not pc.all(known).as_py() and len(known):
                    kept = np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False))])
                    values, offsets = values.filter(known), kept[offsets]
                taken = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(values))
                yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(taken, " ")], names=schema.names)

    return encoded.select(*[f.name for f in schema if f.name != "decoded"]).mapInArrow(run, schema)
