import random

import pytest


@pytest.fixture()
def words():
    """Random texts over a small vocabulary."""

    def make(seed, n, vocabulary=("in", "der", "The", "a,", "x|y", "ça", "zwei.", "b!!"), breaks=(" ", " ", "\n", "  ", "\t")):
        rng = random.Random(seed)
        return "".join(rng.choice(vocabulary) + rng.choice(breaks) for _ in range(n))

    return make


def union(pairs):
    """Representative of each node, by union and find."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {x: find(x) for x in list(parent)}


@pytest.fixture()
def classes():
    return union
