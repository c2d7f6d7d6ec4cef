"""Conversation structure repair: the cheapest edits that give a conversation regular turns, in one streaming pass.

A conversation is regular if the initials of its roles match ``(s?(ua)+)?``: a system turn may come first, then user
and assistant alternate. Edits are Keep (0), Rerole to user or assistant (3), Delete (4) and Insert of an empty turn
(3); a truncated turn that stays adds 3, and blank turns and repeats must be deleted. Of the cheapest edits those
whose initials, in order, are the least in ASCII are taken.

Rows are repartitioned by conversation and sorted by turn; ``mapInPandas`` carries the state of a dynamic program
from row to row, across Arrow batches: the cost and the rank (in order of the initials) of the best edits for each of
four states. Differences of costs and ranks take few values, so a step is one look-up. A step leaves one byte
for each state, from which the edits are read backwards. Conversations of up to ``HELD_ROWS`` rows and
``HELD_BYTES`` of text are decided when they end. Of giant ones, parts of that size are spilled with their bytes as
rows of a Spark table in the shared folder; a second pass goes through the bytes from the last part to the
first, and the parts are then repaired each for itself. So memory is bounded, whatever the conversation's size, and
an executor that is lost costs the repetition of its tasks only.

Defined cases: null roles and texts are one space. Turns are whole numbers; rows are ordered by turn (nulls first),
then by role, then by the text's SHA-256. A row is blank if it has no character but white space, a repeat if role and
text were seen earlier in the conversation, truncated if the last such character is none of ``.!?``; the first of these
counts. Null identifiers are one conversation. Very long texts are a part of their own. An empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.operators.scans import materialize

#: Rows and bytes of text of a conversation that a task holds.
HELD_ROWS, HELD_BYTES = 4096, 4 << 20
#: What a text may consist of and still be blank.
BLANK = " \t\n\x0b\x0c\r"

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NO_WAY = 1 << 60
#: State after one more user or assistant turn, which of the two is not a choice but from EMPTY on: user.
_NEXT = (USER, USER, ASSISTANT, USER)
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3


def _steps(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, str, int]]:
    """(from, to, initials of the edits, cost) of all ways to pass one row, insertions before it included."""
    found = []
    for state in range(4):
        at, edits, cost = state, "", 0
        for _ in range(3):
            found.append((state, at, edits + "D", cost + DELETE))
            if not must_go:
                extra = TRUNCATED if truncated else 0
                if (initial == "s" and at == EMPTY) or (initial in ("u", "a") and initial == "_sua"[_NEXT[at]]):
                    found.append((state, SYSTEM if initial == "s" else _NEXT[at], edits + "K", cost + extra))
                found.append((state, _NEXT[at], edits + "R", cost + RE_ROLE + extra))
            at, edits, cost = _NEXT[at], edits + "I", cost + INSERT
    return found


#: Kinds of rows: an initial and whether the row must go, is truncated, or neither.
KINDS = [(i, f) for i in ("s", "u", "a", "") for f in ("go", "cut", "ok")]
_STEPS = [_steps(i, f == "go", f == "cut") for i, f in KINDS]
#: Edits of one row, as numbers below 64 that hold their place in this list.
EDITS = sorted({e for steps in _STEPS for _, _, e, _ in steps})
_NUMBER = {e: i for i, e in enumerate(EDITS)}
#: Start: cost and rank of each state.
START = ((0, NO_WAY, NO_WAY, NO_WAY), (0, 1, 2, 3))


@lru_cache(maxsize=None)
def advance(state: tuple, kind: int) -> tuple[tuple, int, bytes]:
    """State after a row of this kind, by how much all costs were lowered, and the link of each state.

    A link is the number of the row's edits times four plus the state before. Costs are relative to the
    lowest, so there are few states and each is computed once.
    """
    costs, ranks = state
    best: list[tuple | None] = [None] * 4
    for a, b, edits, cost in _STEPS[kind]:
        if costs[a] < NO_WAY:
            way = (costs[a] + cost, ranks[a], edits, a)
            if best[b] is None or way < best[b]:
                best[b] = way
    lowest = min(way[0] for way in best if way is not None)
    # Strings of different states never begin with one another here, as each ends with the same row.
    order = sorted((way[1:3], b) for b, way in enumerate(best) if way is not None)
    rank = {b: r for r, (_, b) in enumerate(order)}
    after = (
        tuple(NO_WAY if way is None else way[0] - lowest for way in best),
        tuple(rank.get(b, 3) for b in range(4)),
    )
    links = bytes(0 if way is None else _NUMBER[way[2]] * 4 + way[3] for way in best)
    return after, lowest, links


def finish(state: tuple) -> tuple[int, int, str]:
    """Additional cost, state and last insertions of the best end."""
    costs, ranks = state
    ends = [(EMPTY, ""), (SYSTEM, "II"), (USER, "I"), (ASSISTANT, "")]
    ways = [(costs[s] + INSERT * len(tail), ranks[s], tail, s) for s, tail in ends if costs[s] < NO_WAY]
    cost, _, tail, s = min(ways)
    return cost, s, tail


def edits_of(links: bytes, state: int) -> tuple[list[str], int]:
    """Edits of the rows that left these links, and the state before the first, from the state after the last."""
    edits = []
    for at in range(len(links) - 4, -1, -4):
        link = links[at + state]
        edits.append(EDITS[link >> 2])
        state = link & 3
    edits.reverse()
    return edits, state


def apply_edits(edits: list[str], tail: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits, from the state before the first row."""
    out_roles, out_texts = [], []

    def add(role: str | None, text: str) -> None:
        nonlocal state
        after = SYSTEM if role is not None and role[:1] == "s" else _NEXT[state]
        out_roles.append(role if role is not None else ("user" if after == USER else "assistant"))
        out_texts.append(text)
        state = after

    for edit, role, text in zip(edits, roles, texts):
        for _ in edit[:-1]:
            add(None, "")
        if edit[-1] != "D":
            add(role if edit[-1] == "K" else None, text)
    for _ in tail:
        add(None, "")
    return out_roles, out_texts


_TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPAIRED = "part bigint, last boolean, " + "".join(f"{c} bigint, " for c in _TOTALS) + "audit string, roles array<string>, texts array<string>"
_FIRST = _REPAIRED + ", links binary, end_state int, tail string"


class _Conversation:
    """What is carried from row to row."""

    def __init__(self, name: str | None, rows: int, size: int):
        self.name, self.rows, self.size = name, rows, size
        self.state, self.cost, self.part = START, 0, 0
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: tuple | None = None
        self.clear()

    def clear(self) -> None:
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.links = bytearray()
        self.held = 0

    def add(self, turn: int | None, role: str, text: str, digest: str, fault: str) -> Iterator[dict]:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        same = (turn, role, digest)
        if fault in ("", "truncated") and self.before == same:
            fault = "duplicate"
        if self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = same
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        go = fault in ("blank", "duplicate")
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        kind = KINDS.index((initial, "go" if go else "cut" if fault == "truncated" else "ok"))
        size = 0 if go else len(text)
        if self.roles and (len(self.roles) >= self.rows or self.held + size > self.size):
            yield self.row(last=False)
            self.part += 1
            self.clear()
        self.state, lowest, links = advance(self.state, kind)
        self.cost += lowest
        self.links += links
        self.roles.append(role)
        self.texts.append("" if go else text)
        self.held += size

    def row(self, last: bool, **more) -> dict:
        empty = dict.fromkeys([*_TOTALS, "audit", "end_state", "tail"])
        raw = {"roles": self.roles, "texts": self.texts, "links": bytes(self.links)}
        return empty | {"name": self.name, "part": self.part, "last": last} | raw | more

    def end(self) -> dict:
        cost, state, tail = finish(self.state)
        gaps = 0 if self.turns == 0 else self.last_turn - self.first_turn + 1 - self.turns
        totals = dict(zip(_TOTALS, (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost)))
        if self.part:
            return self.row(True, end_state=state, tail=tail, **totals)
        edits, first = edits_of(bytes(self.links), state)
        roles, texts = apply_edits(edits, tail, first, self.roles, self.texts)
        return self.row(True, audit="".join(edits) + tail, **totals) | {"roles": roles, "texts": texts, "links": None}


def _frames(rows: Iterator[dict], columns: list[str], flush: int = 8 << 20) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(map(len, row.get("texts") or ()))
        if size >= flush:
            yield pd.DataFrame(held, columns=columns).astype(object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns).astype(object)


def _columns(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def repair(turns: DataFrame, held_rows: int = HELD_ROWS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Repaired conversations (``conv_id``, ``part``, ``last``, counts, ``audit``, ``roles``, ``texts``), stored.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; a row whose column ``gone`` (if there is one) is true only
    says that its conversation exists. A conversation has one row, a giant one several parts in order; counts
    and cost are on its last part, edits and turns on each.
    """
    prepared = _prepared(turns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict]:
            now = None
            for batch in batches:
                for name, gone, numbered, turn, role, text, digest, fault in batch.itertuples(index=False, name=None):
                    if now is None or name != now.name:
                        if now is not None:
                            yield now.end()
                        now = _Conversation(name, held_rows, held_bytes)
                    if not gone:
                        yield from now.add(int(turn) if numbered else None, role, text, digest, fault)
            if now is not None:
                yield now.end()

        yield from _frames(rows(), ["name", *_columns(_FIRST)])

    first = materialize(prepared.mapInPandas(run, "name string, " + _FIRST))
    columns = ["name", *_columns(_REPAIRED)]
    single = first.filter("last AND part = 0").select(columns)
    several = first.filter("NOT last OR part > 0")
    if not several.isEmpty():
        single = single.unionByName(_repair_parts(several).select(columns))
    type_ = turns.schema["conv_id"].dataType
    return single.withColumn("name", F.col("name").cast(type_)).withColumnRenamed("name", "conv_id")


def _prepared(turns: DataFrame) -> DataFrame:
    """Rows by conversation in order, each with its fault; repeats at one turn are found in the scan."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    rows = turns.select(
        F.col("conv_id").cast("string").alias("name"),
        gone.alias("gone"),
        F.col("turn").isNotNull().alias("numbered"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = rows.withColumns({"last": F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1)), "digest": F.sha2("text", 256)})
    # Texts seen at more than one turn, and the first of these; others cannot repeat an earlier turn.
    place = F.struct("numbered", "turn")
    seen = rows.filter("NOT gone AND last != ''").groupBy("name", "role", "digest").agg(F.min(place).alias("from"), F.max(place).alias("to"))
    seen = seen.filter(F.col("from") != F.col("to")).select(F.col("name").alias("n"), F.col("role").alias("r"), F.col("digest").alias("d"), "from")
    same = F.col("name").eqNullSafe(F.col("n")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    judged = rows.join(materialize(seen), same, "left").withColumn(
        "fault",
        F.when(F.col("last") == "", "blank").when(F.col("from") < place, "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise(""),
    )
    # Texts of rows that must go are not needed any more.
    text = F.when(F.col("fault").isin("blank", "duplicate"), "").otherwise(F.col("text"))
    judged = judged.select("name", "gone", "numbered", "turn", "role", text.alias("text"), "digest", "fault")
    return judged.repartition("name").sortWithinPartitions("name", "numbered", "turn", "role", "digest")


def _repair_parts(several: DataFrame) -> DataFrame:
    """Edits of giant conversations: links are followed from the last part to the first, then parts repaired each."""

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict]:
            name, state = None, 0
            for batch in batches:
                for name_, part, last, links, end_state in batch.itertuples(index=False, name=None):
                    if last:
                        state = int(end_state)
                    name, end = name_, state
                    _, state = edits_of(links, end)
                    yield {"of": name, "of_part": part, "ends": end}

        yield from _frames(rows(), ["of", "of_part", "ends"])

    links = several.select("name", "part", "last", "links", "end_state")
    ordered = links.repartition("name").sortWithinPartitions("name", F.col("part").desc())
    ends = materialize(ordered.mapInPandas(back, "of string, of_part bigint, ends int"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    edits, first = edits_of(row["links"], int(row["ends"]))
                    tail = row["tail"] or ""
                    roles, texts = apply_edits(edits, tail, first, list(row["roles"]), list(row["texts"]))
                    whole = {c: row[c] if row["last"] else None for c in _TOTALS}
                    yield row | whole | {"audit": "".join(edits) + tail, "roles": roles, "texts": texts}

        yield from _frames(rows(), ["name", *_columns(_REPAIRED)])

    met = several.join(ends, F.col("name").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    met = met.select("name", "part", "last", *_TOTALS, "roles", "texts", "links", "tail", "ends")
    return materialize(met.mapInPandas(each, "name string, " + _REPAIRED))


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: its counts, all edits, and the SHA-256 of ``role:text`` lines."""
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    single = repaired.filter("last AND part = 0").select(
        "conv_id", *_TOTALS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")
    )
    several = repaired.filter("NOT last OR part > 0")
    if several.isEmpty():
        return single

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict]:
            digest, audit, any_line = hashlib.sha256(), [], False
            for batch in batches:
                for row in batch.to_dict("records"):
                    audit.append(row["audit"])
                    for role, text in zip(row["roles"], row["texts"]):
                        digest.update(f"{chr(10) if any_line else ''}{role}:{text}".encode())
                        any_line = True
                    if row["last"]:
                        yield row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest(), "texts": None}
                        digest, audit, any_line = hashlib.sha256(), [], False

        yield from _frames(rows(), ["name", *_TOTALS, "audit", "repaired_sha256"])

    named = several.withColumn("name", F.col("conv_id").cast("string")).drop("conv_id")
    ordered = named.repartition("name").sortWithinPartitions("name", "part")
    totals = "".join(f"{c} bigint, " for c in _TOTALS)
    found = ordered.mapInPandas(run, f"name string, {totals}audit string, repaired_sha256 string")
    return single.unionByName(found.withColumn("name", F.col("name").cast(repaired.schema["conv_id"].dataType)).withColumnRenamed("name", "conv_id"))
