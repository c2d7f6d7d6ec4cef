"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, the weight of a term is how often it occurs. For each of ``SAMPLES``
samples and each term, r and c are drawn from the gamma distribution of shape 2 and b uniformly, all from a hash
of the term and the sample's number. With t = floor(ln(weight) / r + b), the sample takes the term with
the smallest ln(c) - r (t - b) - r, together with its t. Two texts take the same pair with a probability equal
to their generalised Jaccard similarity, the sum of the smaller weights over the sum of the larger ones.
A fingerprint holds a 16-bit hash of each pair; the share of equal hashes estimates the similarity.

Draws come from 65,536 quantiles of each distribution, so a task needs no table of terms, and equal texts have
equal fingerprints in whatever task they are computed.

Defined cases: null text is empty; a text without words has a fingerprint of zeros, which is like itself
and unlike others but for chance; order of words, repeated rows and extra columns have no influence.
"""

from __future__ import annotations

from collections.abc import Sequence

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stockloom.llm.arrow import WordTable, split_words, with_columns

SAMPLES = 64
#: Samples that are computed at once; bounds the memory of a worker.
_AT_ONCE = 8
_QUANTILES = 1 << 16


def gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 and scale 1 at the middles of equal shares."""
    share = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
    x = np.full(_QUANTILES, 1.0)
    low, high = np.zeros(_QUANTILES), np.full(_QUANTILES, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        above = 1 - np.exp(-x) * (1 + x) > share
        low, high = np.where(above, low, x), np.where(above, x, high)
    return x


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Fingerprints of blocks of texts in one task."""

    def __init__(self):
        gamma = gamma_quantiles()
        self.gamma, self.log_gamma = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.uniform = ((np.arange(_QUANTILES) + 0.5) / _QUANTILES).astype(np.float32)
        self.words = WordTable(lambda w: (xxhash.xxh3_64_intdigest(w) - (1 << 63),), 1)
        self.seeds = _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, texts: Sequence[str | None]) -> np.ndarray:
        """One row of ``SAMPLES`` 16-bit numbers for each text."""
        words = [split_words(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
        out = np.zeros((len(texts), SAMPLES), np.uint16)
        if not len(ids):
            return out
        # Terms in the order of their hashes, so that ties fall the same way in every task.
        terms, place = np.unique(self.words.columns()[ids, 0], return_inverse=True)
        self.words.trim()
        owner = np.repeat(np.arange(len(texts)), lengths)
        pairs, times = np.unique(owner * len(terms) + place, return_counts=True)
        of, term = np.divmod(pairs, len(terms))
        starts = np.searchsorted(of, np.arange(len(texts) + 1))
        log_weight = np.log(np.arange(1, int(times.max()) + 1)).astype(np.float32)[times - 1]
        hashes = terms.view(np.uint64)
        filled = [(d, int(starts[d]), int(starts[d + 1])) for d in range(len(texts)) if starts[d] < starts[d + 1]]
        documents = np.array([d for d, _, _ in filled], np.int64)
        row = np.arange(_AT_ONCE)[:, None]
        for at in range(0, SAMPLES, _AT_ONCE):
            drawn = _mixed(hashes[None, :] ^ self.seeds[at : at + _AT_ONCE, None])
            r = self.gamma[(drawn & np.uint64(0xFFFF)).astype(np.int64)][:, term]
            log_c = self.log_gamma[(drawn >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)][:, term]
            b = self.uniform[(drawn >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64)][:, term]
            t = np.floor(log_weight / r + b)
            # The smallest of ln(c) - r (t - b) - r, in place.
            b -= t
            b -= 1
            b *= r
            b += log_c
            best = np.empty((_AT_ONCE, len(filled)), np.int64)
            for place, (_, start, end) in enumerate(filled):
                best[:, place] = b[:, start:end].argmin(1)
                best[:, place] += start
            pair = _mixed(drawn[row, term[best]] + t[row, best].astype(np.int64).astype(np.uint64))
            out[documents, at : at + _AT_ONCE] = (pair & np.uint64(0xFFFF)).astype(np.uint16).T
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples of two fingerprints (rows)."""
    return (a == b).mean(axis=-1)


def compared(df: DataFrame, texts: Sequence[str], fingerprints: Sequence[str], likenesses: dict[str, tuple[int, int]], keep: list[str]) -> DataFrame:
    """Add the fingerprint of each text column, as 4 hex digits a sample, and the likeness of pairs of them.

    ``fingerprints`` names the added columns, in the order of ``texts``; ``likenesses`` maps names to pairs of
    positions in it. Texts that are equal within a block are sampled once.
    """

    def make():
        sampler = Sampler()

        def block(*columns):
            place: dict[str, int] = {}
            rows = [[place.setdefault(t or "", len(place)) for t in column] for column in columns]
            found = sampler(list(place))
            digits = [row.byteswap().tobytes().hex() for row in found]
            hexes = [[digits[i] for i in row] for row in rows]
            near = [likeness(found[rows[a]], found[rows[b]]) for a, b in likenesses.values()]
            return [*hexes, *near]

        return block

    adds = [(f, T.StringType(), pa.string()) for f in fingerprints]
    adds += [(n, T.DoubleType(), pa.float64()) for n in likenesses]
    return with_columns(df, texts, make, adds, keep)


def with_fingerprint(documents: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text column; all columns are kept."""
    return compared(documents, [text], [name], {}, documents.columns)
