"""The relational scope extraction against a plain model of its rules."""

import itertools
import random
import re

import pytest

from stockloom.operators.scoped_text import scoped_extract


class Block:
    """A pair of braces: its place in the file's events, what encloses it, and the condition before it."""

    def __init__(self, parent, opened, condition=None):
        self.parent, self.opened, self.condition = parent, opened, condition
        self.closed = float("inf")

    def chain(self):
        """This block and those around it, the outermost first."""
        return (self.parent.chain() if self.parent else []) + [self]


TOKENS = re.compile(r"\.SetDefaults\(([0-9]+)\)|([{}])")


def events(lines):
    """(kind, value) of all that matters from the marker on: heads of a line, its items, then its braces."""
    body = itertools.dropwhile(lambda text: "public void SetupShop(int type)" not in text, lines)
    for number, line in enumerate(body):
        text = line.strip()
        if text.startswith("switch (type)"):
            yield "switch", None
        if label := re.match(r"case\s+([0-9]+)\s*:", text):
            yield "case", int(label[1])
        if condition := re.match(r"(?:else\s+)?if\s*\((.+)\)", text):
            plain = re.sub(r"Main\.(LocalPlayer|player\[Main\.myPlayer\])\.", "player.", condition[1].strip())
            yield "if", re.sub(r"\s+", " ", plain)
        found = TOKENS.findall(line)
        yield from (("item", int(item)) for item, _ in found if item)
        yield from ((brace, None) for _, brace in found if brace)
        yield "end", number


def model(lines):
    """Blocks as a tree first; then each item is looked up from its innermost block outwards."""
    tree, leaves = Block(None, -1), []
    here, depth = tree, 0
    log = list(events(lines))
    for at, (kind, value) in enumerate(log):
        if kind == "{":
            here, depth = Block(here, at), depth + 1
        elif kind == "}":
            here.closed, here, depth = at, here.parent or tree, depth - 1
        elif kind == "end" and value and depth <= 0:
            log = log[:at]
            break
        leaves.append(here)

    def before(at, *kinds):
        """Place of the last event of these kinds before a place."""
        return next((i for i in range(at - 1, -1, -1) if log[i][0] in kinds), -1)

    # A switch is the first block after a header that stands in no other switch.
    switches = []
    for at, (kind, _) in enumerate(log):
        if kind == "switch" and not any(s.opened < at < s.closed for s in switches):
            opened = next((i for i in range(at, len(log)) if log[i][0] == "{"), None)
            if opened is not None and all(s.opened != opened for s in switches):
                switches.append(leaves[opened])
    # A label counts directly inside a switch.
    labels = [at for at, (kind, _) in enumerate(log) if kind == "case" and leaves[at] in switches]
    # A block has the last condition before it, unless a block or a label stands between.
    for at, (kind, _) in enumerate(log):
        if kind == "{":
            last = before(at, "if")
            if last > max(before(at, "{"), max((x for x in labels if x < at), default=-1)) and log[last][1].strip():
                leaves[at].condition = log[last][1]
    found = {}
    for at, (kind, item) in enumerate(log):
        inside = [s for s in switches if s.opened < at < s.closed]
        label = max((x for x in labels if x < at and inside and x > inside[-1].opened), default=None)
        if kind == "item" and label is not None and log[label][1] > 0:
            conditions = [x.condition for x in leaves[at].chain() if x.opened > label and x.condition]
            found.setdefault((log[label][1], item), {}).update(dict.fromkeys(conditions))
    return {key: list(conditions) for key, conditions in found.items()}


HEAD = ["class Chest", "{", "  public void SetupShop(int type)", "  {", "    switch (type)", "    {"]
TAIL = ["    }", "  }", "}"]


def wrap(*body):
    return HEAD + list(body) + TAIL


CASES = {
    "nested": wrap("case 1:", "if (a)", "{", "if (b && (c))", "{", "x.SetDefaults(5);", "}", "x.SetDefaults(6);", "}", "x.SetDefaults(7);"),
    "else_if": wrap("case 2:", "if (a)", "{", "x.SetDefaults(1);", "}", "else if (b)", "{", "x.SetDefaults(2);", "}"),
    "else": wrap("case 3:", "if (a)", "{", "x.SetDefaults(1);", "}", "else", "{", "x.SetDefaults(2);", "}"),
    "leak": wrap("case 4:", "if (a)", "x.SetDefaults(1);", "for (;;)", "{", "x.SetDefaults(2);", "}"),
    "stacked": wrap("case 5:", "case 6:", "x.SetDefaults(1);"),
    "cleared_pending": wrap("case 5:", "if (a)", "x.SetDefaults(9);", "case 6:", "{", "x.SetDefaults(1);", "}"),
    "nested_switch": wrap("case 7:", "switch (other)", "{", "case 9:", "x.SetDefaults(3);", "}", "x.SetDefaults(4);"),
    "nested_same_switch": wrap("case 7:", "switch (type)", "{", "case 9:", "x.SetDefaults(3);", "}", "x.SetDefaults(4);"),
    "same_line": wrap("case 8:", "if (a) { x.SetDefaults(1);", "x.SetDefaults(2); }", "x.SetDefaults(3);"),
    "blank_after": HEAD[:3] + [""] + HEAD[3:] + ["case 1:", "x.SetDefaults(1);"] + TAIL,
    "no_marker": ["switch (type)", "{", "case 1:", "x.SetDefaults(1);", "}"],
    "case_zero": wrap("case 0:", "x.SetDefaults(1);", "case 1:", "x.SetDefaults(2);"),
    "two_switches": HEAD + ["case 1:", "x.SetDefaults(1);", "    }", "switch (type)", "{", "case 2:", "if (z)", "{", "x.SetDefaults(2);", "}", "}"] + TAIL[1:],
    "brace_on_signature": ["public void SetupShop(int type) {", "", "switch (type) {", "case 1: x.SetDefaults(4);", "}", "}"],
    "normalised": wrap("case 1:", "if (Main.LocalPlayer.a   &&  Main.player[Main.myPlayer].b)", "{", "x.SetDefaults(1); y.SetDefaults(2);", "}"),
    "repeat": wrap("case 1:", "if (a)", "{", "x.SetDefaults(1);", "}", "if (b)", "{", "if (a)", "{", "x.SetDefaults(1);", "}", "}"),
    "after_end": wrap("case 1:", "x.SetDefaults(1);") + ["switch (type)", "{", "case 2:", "x.SetDefaults(2);", "}"],
    "blank_condition": wrap("case 1:", "if ( )", "{", "x.SetDefaults(1);", "}"),
    "overwritten": wrap("case 1:", "if (a)", "if (b)", "{", "x.SetDefaults(1);", "}"),
}


# What each hand-made file gives: (case, item) with its conditions.
EXPECTED = {
    "nested": {(1, 5): ["a", "b && (c)"], (1, 6): ["a"], (1, 7): []},
    "else_if": {(2, 1): ["a"], (2, 2): ["b"]},
    "else": {(3, 1): ["a"], (3, 2): []},
    "leak": {(4, 1): [], (4, 2): ["a"]},
    "stacked": {(6, 1): []},
    "cleared_pending": {(5, 9): [], (6, 1): []},
    "nested_switch": {(7, 3): [], (7, 4): []},
    "nested_same_switch": {(7, 3): [], (7, 4): []},
    "same_line": {(8, 1): [], (8, 2): ["a) { x.SetDefaults(1"], (8, 3): []},
    "blank_after": {},
    "no_marker": {},
    "case_zero": {(1, 2): []},
    "two_switches": {(1, 1): [], (2, 2): ["z"]},
    "brace_on_signature": {(1, 4): []},
    "normalised": {(1, 1): ["player.a && player.b"], (1, 2): ["player.a && player.b"]},
    "repeat": {(1, 1): ["a", "b"]},
    "after_end": {(1, 1): []},
    "blank_condition": {(1, 1): []},
    "overwritten": {(1, 1): ["b"]},
}


def random_file(rng):
    out = list(HEAD) if rng.random() < 0.9 else HEAD[:2] + ["public void SetupShop(int type)", "", "{"]
    depth = 0
    for _ in range(rng.randint(3, 60)):
        pick = rng.random()
        if pick < 0.18:
            out.append(f"case {rng.randint(0, 9)}:")
        elif pick < 0.36:
            out.append(rng.choice(["if", "else if"]) + f" (c{rng.randint(0, 4)})" + rng.choice(["", " {", " { x.SetDefaults(77);"]))
            depth += out[-1].count("{")
        elif pick < 0.5:
            out.append("{")
            depth += 1
        elif pick < 0.62 and depth:
            out.append("}")
            depth -= 1
        elif pick < 0.66:
            out += ["switch (other)", "{"]
            depth += 1
        elif pick < 0.68:
            out.append("}" * rng.randint(1, 2) + "{" * rng.randint(0, 1))
        elif pick < 0.72:
            out += ["switch (type)", "{"]
            depth += 1
        elif pick < 0.76:
            out.append("")
        else:
            out.append(" ".join(f"x.SetDefaults({rng.randint(1, 30)});" for _ in range(rng.randint(1, 2))))
    return out + ["}"] * depth + TAIL


def run(spark, files, **options):
    data = [(name, n, text) for name, body in files.items() for n, text in enumerate(body, 1)]
    lines = spark.createDataFrame(data, "file string, line_no bigint, line string")
    got = {name: {} for name in files}
    for r in scoped_extract(lines, **options).collect():
        got[r["file"]][(r["case_id"], r["item_id"])] = list(r["conditions"])
    return got


@pytest.mark.parametrize("block", [3, 100_000])
def test_hand_made_files(spark, block):
    got = run(spark, CASES, block_lines=block)
    assert got == EXPECTED
    assert {name: model(body) for name, body in CASES.items()} == EXPECTED


@pytest.mark.parametrize("block", [4, 100_000])
def test_generated_files(spark, block):
    rng = random.Random(11)
    files = {f"f{i}": random_file(rng) for i in range(150)}
    got = run(spark, files, block_lines=block)
    wanted = {name: model(body) for name, body in files.items()}
    assert sum(len(v) for v in wanted.values()) > 200
    assert sum(1 for v in wanted.values() for c in v.values() if c) > 50
    for name in files:
        assert got[name] == wanted[name], (name, files[name])


def test_only_items_and_a_row_for_each_block_are_stored(spark):
    """Lines are dealt out once: what is stored grows with the items and not with the events of the text."""
    from stockloom.operators import scans

    body = ["    case 7:", "if (a)", "{", "if (b) {", "x.SetDefaults(5);", "}", "}", "{", "}", "{", "}"] * 40
    text = ["public void SetupShop(int type) {", "switch (type) {", *body, "} }"]
    lines = spark.createDataFrame([("f", n, line) for n, line in enumerate(text)], "file string, line_no bigint, line string")
    before = len(scans._written)
    found = scoped_extract(lines, block_lines=50).collect()
    stored = sum(spark.read.parquet(path).count() for path in scans._written[before:])
    assert [tuple(r) for r in found] == [("f", 7, 5, ["a", "b"])]
    blocks = len(text) // 50 + 1
    assert stored <= 40 + 2 * blocks + 1


@pytest.mark.parametrize("block", [7, 100_000])
def test_repeated_items_are_folded_by_case_and_conditions(spark, block):
    """Only what is equal in case, number and conditions is folded, wherever its switch opens."""
    rng = random.Random(5)
    parts = ["x.SetDefaults(5);", "if (a) {", "x.SetDefaults(5); x.SetDefaults(6);", "}", "if (a)", "case 1:", "case 2:", "{", "if (b) {"]
    bodies = [[rng.choice(parts) for _ in range(60)] for _ in range(40)]
    bodies = [[*body, *["}"] * (sum(p.count("{") - p.count("}") for p in body))] for body in bodies]
    files = {f"f{i}": wrap("case 3:", "x.SetDefaults(5);", "x.SetDefaults(5);", *body) for i, body in enumerate(bodies)}
    assert run(spark, files, block_lines=block) == {name: model(body) for name, body in files.items()}


def test_lines_are_computed_once(spark):
    """The text is not read before to find its markers."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    text = [*["// nothing"] * 30, *wrap("case 7:", "x.SetDefaults(5);"), *wrap("case 8:", "x.SetDefaults(6);")]
    lines = spark.createDataFrame([("f", n, line) for n, line in enumerate(text)], "file string, line_no bigint, line string")
    found = scoped_extract(lines.mapInArrow(count, lines.schema), block_lines=5).collect()
    assert [tuple(r) for r in found] == [("f", 7, 5, [])]
    assert seen.value == len(text)
