"""License scans: units of a text against licence templates by the Dice coefficient of word bigrams.

A text is normalised (A-Z in lower case, runs of other than letters and digits to one space), and cut into
units: its lines, its paragraphs (parted by blank lines) and the whole. A unit with the set A of bigrams of
adjacent words matches a template with the set B if 2 |A and B| / (|A| + |B|) is at least ``THRESHOLD``. As
the intersection is no larger than either set, |A| must lie between |B| t / (2 - t) and |B| (2 - t) / t; only
templates with such bounds are compared. Texts without any of a few words, one of which every match must
contain, are not cut at all. Everything is computed inside a row with array functions:
no shuffle, no join, and nothing depends on how many documents share a licence.

Defined cases: null or empty text has no units and no licence; a unit of fewer than two words has no bigrams;
equal units of a text count once; of equal coefficients the template first by name wins; repeated rows
and extra columns are kept, and columns that are added replace those of the same name.
"""

from __future__ import annotations

import math
import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.arrow import fresh

THRESHOLD = 0.8

# The wording of licence notices and licence paragraphs.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
    " that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to"
    " this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    ' associated documentation files (the "Software"), to deal in the Software without restriction, including without'
    " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
    " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

ADDED = ("license", "dice", "n_matches", "licenses")


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.sub(r"[^0-9a-z]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can match a template of ``n`` bigrams."""
    slack = 1e-9
    return math.ceil(n * threshold / (2 - threshold) - slack), math.floor(n * (2 - threshold) / threshold + slack)


def normalised(text: Column) -> Column:
    """Line breaks stay; all else but letters and digits becomes one space."""
    lower = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.regexp_replace(lower, r"[^\p{L}\p{N}\n]+", " ")


def units(text: Column) -> Column:
    """Lines, paragraphs and the whole of a normalised text, without repeats and surrounding spaces."""
    flat = lambda u: F.trim(F.regexp_replace(u, r"[ \n]+", " "))
    # Paragraphs and the whole only differ from the lines where there are several lines.
    larger = F.when(
        F.contains(text, F.lit("\n")), F.array_append(F.transform(F.split(text, r"\n *\n"), flat), flat(text))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.transform(F.split(text, "\n"), lambda u: F.trim(u)), larger))


def anchors(pairs: list[str], threshold: float = THRESHOLD) -> list[str]:
    """Words one of which stands in every unit that matches the template.

    A match shares at least ``threshold (low + n) / 2`` of the n bigrams, so words that touch more than the
    rest of them cannot all be absent. Long words are preferred, as they are rare.
    """
    n = len(pairs)
    low, _ = size_bounds(n, threshold)
    needed = n - math.ceil(threshold * (low + n) / 2 - 1e-9) + 1
    left, chosen = set(pairs), []
    while n - len(left) < needed:
        words = {w for p in left for w in p.split(" ")}
        touched = {w: sum(w in p.split(" ") for p in left) for w in words}
        best = max(words, key=lambda w: (len(w) > 3, touched[w] * len(w), w))
        chosen.append(best)
        left = {p for p in left if best not in p.split(" ")}
    return chosen


def may_match(text: Column, templates: dict[str, str], threshold: float) -> Column:
    """False only for texts no unit of which can match: none of the anchor words is in them."""
    words = {w for wording in templates.values() for w in anchors(template_bigrams(wording), threshold)}
    lower = F.lower(text)
    found = F.lit(False)
    long = sorted(w for w in words if len(w) > 3)
    for word in long:
        # A word that contains another anchor is found with it.
        if not any(other != word and other in word for other in long):
            found = found | F.contains(lower, F.lit(word))
    if short := "|".join(sorted(words.difference(long))):
        # Short ones must stand alone; what surrounds them is looked at after they are found.
        sign = r"[\p{L}\p{N}]"
        found = found | lower.rlike(f"(?:{short})(?<!{sign}(?:{short}))(?!{sign})")
    return found


def bigrams(words: Column) -> Column:
    """Distinct bigrams of adjacent words."""
    last = F.size(words) - 1
    pairs = F.zip_with(
        F.slice(words, 1, last), F.slice(words, 2, last), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.array_distinct(pairs)


def matches(sets: Column, templates: dict[str, str], threshold: float) -> Column:
    """Array of ``dice``, ``license`` for each set of bigrams and template that match."""
    rows = []
    for name, wording in sorted(templates.items()):
        pairs = template_bigrams(wording)
        low, high = size_bounds(len(pairs), threshold)
        rows.append(
            F.struct(
                F.lit(name).alias("name"), F.lit(len(pairs)).alias("n"), F.lit(low).alias("low"),
                F.lit(high).alias("high"), F.array(*map(F.lit, pairs)).alias("pairs"),
            )
        )
    known = F.array(*rows)

    def against(found: Column) -> Column:
        within = F.filter(known, lambda t: F.size(found).between(t["low"], t["high"]))
        return F.transform(
            within,
            lambda t: F.struct(
                (F.lit(2.0) * F.size(F.array_intersect(found, t["pairs"])) / (F.size(found) + t["n"])).alias("dice"),
                t["name"].alias("license"),
            ),
        )

    return F.filter(F.flatten(F.transform(sets, against)), lambda m: m["dice"] >= threshold)


def scan(documents: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``license`` and ``dice`` of the best match, ``n_matches``, and ``licenses`` (names in order)."""
    wanted = TEMPLATES if templates is None else templates
    fewest = min((size_bounds(len(template_bigrams(w)), threshold)[0] for w in wanted.values()), default=0)
    rest = [c for c in documents.columns if c not in ADDED]
    # Each step is a column of its own, so that it is computed once for all that read it.
    flat, cut, found = (fresh(documents, n) for n in ("_flat", "_cut", "_found"))
    text = F.coalesce("text", F.lit(""))
    held = documents.withColumn(flat, F.when(may_match(text, wanted, threshold), normalised(text)))
    # A unit of n words has at most n - 1 bigrams, so short units need no comparison.
    held = held.withColumn(cut, F.transform(units(F.col(flat)), lambda u: F.split(u, " ")))
    sets = F.transform(F.filter(cut, lambda w: F.size(w) > fewest), bigrams)
    held = held.withColumn(found, F.coalesce(matches(sets, wanted, threshold), F.array()))
    best = F.array_min(F.transform(found, lambda x: F.struct((-x["dice"]).alias("d"), x["license"])))
    return held.select(
        *rest,
        best["license"].alias("license"),
        (-best["d"]).alias("dice"),
        F.size(found).alias("n_matches"),
        F.array_sort(F.array_distinct(F.transform(found, lambda x: x["license"]))).alias("licenses"),
    )
