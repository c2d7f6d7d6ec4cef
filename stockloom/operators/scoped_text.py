"""Scoped extraction: ids in brace-structured text, with the conditions that enclose them.

Input is (file, line_no, line). After a marker line, a ``switch (type)`` block holds ``case N:``
sections; each ``.SetDefaults(n)`` in a section is recorded with the conditions of all open ``if``
blocks, outermost first.

Lines are parsed row by row, once, and those that matter are dealt out once, by blocks of consecutive line
numbers. A block is read in order without knowing what is open before it: its items name the blocks
opened beside them inside the block of lines, and how many of the outer ones are closed by then. One summary row per
block of lines says the same of its end. A block of lines with a marker line is read twice, from its start and from that
line, as it is not known there whether an earlier one holds a marker. From the summaries of a file follows what is
open before each of its blocks of lines, and items and outer blocks meet in one join:

* the switch of a line is the outermost switch brace in its chain of open blocks;
* a ``case`` counts when the innermost open brace is that switch brace;
* the case of an item is the latest counted case of the same switch brace;
* a brace opens a condition when the latest ``if`` since the previous ``{`` is not blank and no
  counted case came in between.

So neither a huge file nor a huge block of text lands in one task; the summaries of one file do (its
lines / ``block_lines`` rows).

One known limit: a switch header inside an open switch that has no ``{`` before that switch closes
is treated as opening the next block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.functions.text import WHITESPACE, is_blank, normalize_condition
from stockloom.operators.scans import DEFAULT_BLOCK, materialize

# Markers and patterns of the text format.
START_MARKER = "public void SetupShop(int type)"
SWITCH_MARKER = "switch (type)"
CASE_PATTERN = r"(?U)^case\s+([0-9]+)\s*:"
IF_PATTERN = r"(?U)^(?:else\s+)?if\s*\((.+)\)"
ITEM_PATTERN = r"\.SetDefaults\(([0-9]+)\)"

# A text in which one of these patterns is found holds this word, which is much cheaper to look for.
_WORDS = {CASE_PATTERN: "case", IF_PATTERN: "if", ITEM_PATTERN: ".SetDefaults("}

# No line has a greater number.
_LAST = (1 << 63) - 1

# Lines that stand in one row when they are handed over to be read.
_LINES_AT_ONCE = 2_000

# An open block: its condition and the line of that, whether it is a switch, and its latest case. In the rows of a block
# of lines, the first one may take its condition (if_line -1) and its switch header (null) from earlier lines.
_OPENED = "array<struct<condition: string, if_line: bigint, is_switch: boolean, case_id: int, case_line: bigint>>"
_END = "depth bigint, header boolean, pending string, pending_line bigint"
_READ = (
    "block bigint, from_marker boolean, line_no bigint, col int, item_id int, lowest bigint, base bigint, case_id int, "
    f"case_line bigint, plain boolean, inside array<string>, first_line bigint, {_END}, opened {_OPENED}"
)
_CARRIED = (
    f"block bigint, from_marker boolean, {_END}, switch_at bigint, switch_case_id int, outer {_OPENED}"
)


def match_all(text: Column, pattern: str = ITEM_PATTERN, group: int = 1) -> Column:
    """All matches of a group, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def case_label(trimmed: Column, pattern: str = CASE_PATTERN) -> Column:
    """The number of a ``case N:`` line, else null."""
    digits = F.regexp_extract(trimmed, pattern, 1)
    # A failing try_cast costs an exception, so lines without a label do not reach it.
    return F.when(digits != "", digits.try_cast("int"))


def condition_text(trimmed: Column, pattern: str = IF_PATTERN) -> Column:
    """Text inside an ``if`` / ``else if`` line up to its last ``)``; ``''`` for other lines."""
    return F.regexp_extract(trimmed, pattern, 1)


def _may_match(text: Column, pattern: str) -> Column:
    return text.contains(_WORDS[pattern]) if pattern in _WORDS else text.rlike(pattern)


def _parsed_lines(lines: DataFrame, start: str, switch: str, patterns: dict[str, str]) -> DataFrame:
    """Lines that may matter, parsed row by row. A line that does not matter changes nothing."""
    line, raw = F.col("line"), F.col("raw_condition")
    # Whitespace at the end of a line does not matter to any of the patterns.
    trimmed = F.ltrim(line, F.lit(WHITESPACE))
    # Trimming costs more than looking for a word, so a word is looked for first.
    case, condition = ((_may_match(line if patterns[k] in _WORDS else trimmed, patterns[k])) for k in ("case", "if"))
    item = _may_match(line, patterns["item"])
    braces = line.contains("{") | line.contains("}")
    return (
        lines.filter(F.col("file").isNotNull() & F.col("line_no").isNotNull())
        .filter(braces | item | case | condition | line.contains(start) | line.contains(switch))
        .select(
            "file",
            F.col("line_no").cast("bigint").alias("line_no"),
            line.contains(start).alias("is_start"),
            (line.contains(switch) & trimmed.startswith(switch)).alias("is_switch"),
            F.when(case, case_label(trimmed, patterns["case"])).alias("case_id"),
            F.when(condition, condition_text(trimmed, patterns["if"])).alias("raw_condition"),
            F.when(item, F.transform(match_all(line, patterns["item"]), lambda x: x.try_cast("int"))).alias("items"),
            F.when(braces, F.regexp_replace("line", r"[^{}]+", "")).otherwise("").alias("braces"),
        )
        .withColumn("raw_condition", F.when(raw != "", normalize_condition(raw)))
        .withColumnRenamed("raw_condition", "condition")
    )


def _block_reader(schema: T.StructType, block_lines: int, fold: bool):
    """The function that reads the lines of one block in order: a row per item, and one for the block's end.

    Depths are relative to the start of the block. ``base``: how deep the outer blocks are cut down; ``case_*``: the
    latest case directly above what is left of them; ``lowest``: the lowest depth at the end of an earlier line;
    ``inside``: the conditions of the blocks beside an item, if none of these may be a switch, takes its condition from
    earlier lines or loses it to a case in between (``plain``). Of others ``opened`` has all that is known.

    ``fold``: of the items of one number, case and list of conditions only the first is returned, where
    all blocks beside it are plain.
    """
    names = schema.fieldNames()

    # Nested, so that it is sent with the tasks and executors need no copy of the package.
    def read(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        far = 1 << 40

        def latest(marks, lines):
            """The last of the sorted ``marks`` that is no greater, or -1."""
            return np.concatenate(([-1], marks))[np.searchsorted(marks, lines, side="right")]

        def scan(part, file, block, from_marker):
            n = part.num_rows
            numbers = part["line_no"].to_numpy()
            case_lines = np.flatnonzero(part["case_id"].is_valid().to_numpy())
            case_ids = part["case_id"].fill_null(0).to_numpy()
            coded = part["condition"].combine_chunks().dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            conditions = coded.dictionary.cast(pa.string())
            # Code -1, no condition, is the last one here.
            counts = np.append(pc.not_equal(conditions, "").to_numpy(zero_copy_only=False), False)

            # Braces in order. ``depth`` and ``floor`` (the lowest depth) are those after so many of them.
            lengths = pc.binary_length(part["braces"]).to_numpy().astype(np.int64)
            joined = pc.binary_join(pa.ListArray.from_arrays([0, n], part["braces"].combine_chunks()), "")
            text = np.frombuffer(joined[0].as_py().encode(), np.uint8)
            sign = np.where(text == ord("{"), 1, -1)
            at = np.concatenate(([0], np.cumsum(lengths)))
            m = len(sign)
            depth = np.concatenate(([0], np.cumsum(sign)))
            floor = np.minimum.accumulate(depth)
            ups = np.flatnonzero(sign > 0)
            up_depth = depth[ups + 1] - floor[-1]
            up_line = np.repeat(np.arange(n), lengths)[ups]
            by_depth = np.argsort(up_depth, kind="stable")
            up_keys = up_depth[by_depth] * (m + 1) + ups[by_depth]

            def innermost(met):
                """The opening brace that encloses the place after so many braces, -1 where it is an outer one."""
                place = np.searchsorted(up_keys, (depth[met] - floor[-1]) * (m + 1) + met) - 1
                return np.where(depth[met] > floor[met], np.append(by_depth, -1)[place], -1)

            parent, top, base = innermost(ups), innermost(at[:-1]), floor[at]
            # A condition and a header belong to the next opening brace.
            before = np.concatenate(([-1], up_line[:-1]))[: len(ups)]
            if_lines, switch_lines = np.flatnonzero(codes >= 0), np.flatnonzero(part["is_switch"].to_numpy())
            up_if, up_switch = latest(if_lines, up_line), latest(switch_lines, up_line)
            up_if = np.where(up_if > before, up_if, -1)
            up_code = np.where(up_if >= 0, codes[up_if], -1)
            is_switch, first = up_switch > before, np.arange(len(ups)) == 0
            takes_if, takes_header = first & (up_if < 0), first & ~is_switch
            # The latest case directly inside a block, or inside what is left of the outer ones.
            case_top = top[case_lines]
            by_top = np.argsort(case_top, kind="stable")
            case_keys = (case_top[by_top] + 1) * (n + 1) + case_lines[by_top]

            def case_of(up, line):
                place = np.searchsorted(case_keys, (up + 1) * (n + 1) + line, side="right") - 1
                found = np.append(case_lines[by_top], -1)[place]
                return np.where((place >= 0) & (np.append(case_top[by_top], -2)[place] == up), found, -1)

            def base_case(line, floor_there):
                found = case_of(np.full(len(line), -1), line)
                return np.where((found >= 0) & (base[found] == floor_there), found, -1)

            holds = counts[up_code] & (up_if >= base_case(up_line, floor[ups]))

            listed = pc.fill_null(pc.list_value_length(part["items"]), 0).to_numpy().astype(np.int64)
            values = part["items"].combine_chunks().flatten()
            line = np.repeat(np.arange(n), listed)
            col = lengths[line] + 2 + np.arange(len(line)) - np.repeat(np.cumsum(listed) - listed, listed)
            item = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            valid = values.is_valid().to_numpy(zero_copy_only=False)
            line, col, item = line[valid], col[valid], item[valid]

            unclear = is_switch | takes_if | takes_header | (counts[up_code] & ~holds)
            if fold and len(line):
                # Blocks of equal conditions, their own and those around them, get one number; none beside or inside an unclear one.
                number, used = np.zeros(len(ups) + 1, np.int64), 0
                doubtful, own = np.append(unclear, False), up_code + 1
                for same_depth in np.split(by_depth, np.flatnonzero(np.diff(up_depth[by_depth])) + 1):
                    doubtful[same_depth] |= doubtful[parent[same_depth]]
                    pairs = number[parent[same_depth]] * (len(conditions) + 1) + own[same_depth]
                    found, number[same_depth] = np.unique(pairs, return_inverse=True)
                    number[same_depth] += used + 1
                    used += len(found)
                case = base_case(line, base[line])
                cases = np.where(case >= 0, np.append(case_ids, 0)[case], far - base[line])
                scope = number[top[line]] * len(line) + np.unique(cases, return_inverse=True)[1]
                scope = np.where(doubtful[top[line]], -1 - np.arange(len(line)), scope)
                scope = np.unique(scope, return_inverse=True)[1]
                kept = np.sort(np.unique(scope * (1 << 32) + item % (1 << 32), return_index=True)[1])
                line, col, item = line[kept], col[kept], item[kept]

            # The rows: items, then the end of the block with what is open there.
            line, n_items = np.append(line, n), len(line)
            met = at[line]
            size, up = depth[met] - floor[met], innermost(met)
            stops = np.cumsum(size)
            chain, rows, step = np.empty(stops[-1], np.int64), np.arange(len(line)), 0
            while True:
                deeper = size[rows] > step
                rows, up = rows[deeper], up[deeper]
                if not len(rows):
                    break
                step += 1
                chain[stops[rows] - step] = up
                up = parent[up]
            stops = np.concatenate(([0], stops))

            def places(mask):
                return np.concatenate(([0], np.cumsum(mask)))[stops]

            def numbered(source, where, absent, kind):
                return pa.array(np.append(source, 0)[where], kind, mask=absent)

            is_item = np.arange(len(line)) < n_items
            plain = is_item & (np.diff(places(unclear[chain])) == 0)
            named = np.repeat(plain, size) & counts[up_code[chain]]
            inside = conditions.take(pa.array(up_code[chain[named]]))
            rest = np.repeat(~plain, size)
            beside, beside_line = chain[rest], np.repeat(line, size)[rest]
            in_case, inherits = case_of(beside, beside_line), takes_if[beside]
            opened = {
                "condition": conditions.take(pa.array(up_code[beside], mask=up_code[beside] < 0)),
                "if_line": numbered(np.append(numbers, -1), np.where(inherits, n, up_if[beside]), ~inherits & (up_if[beside] < 0), pa.int64()),
                "is_switch": pa.array(is_switch[beside], pa.bool_(), mask=takes_header[beside]),
                "case_id": numbered(case_ids, in_case, in_case < 0, pa.int32()),
                "case_line": numbered(numbers, in_case, in_case < 0, pa.int64()),
            }
            opened = pa.StructArray.from_arrays(list(opened.values()), names=list(opened))
            lows = depth[at[1:]].copy()
            if from_marker:
                lows[0] = far
            lowest = np.minimum.accumulate(np.concatenate(([far], lows)))
            if from_marker and n > 1 and depth[at[1]] <= 0 and numbers[1] > numbers[0] + 1:
                lowest[1:] = -far
            case = base_case(line, base[line])

            def lists(mask, values):
                return pa.ListArray.from_arrays(pa.array(places(mask), pa.int32()), values)

            def at_end(value, kind):
                return pa.concat_arrays([pa.nulls(n_items, kind), pa.array([value], kind)])

            def of_items(found, kind):
                return pa.array(np.append(found, 0), kind, mask=~is_item)

            last_up = up_line[-1] if len(ups) else -1
            last_if, last_switch = (marks[-1] if len(marks) and marks[-1] > last_up else -1 for marks in (if_lines, switch_lines))
            columns = {
                "file": pa.repeat(file, len(line)),
                "block": pa.array(np.full(len(line), block)),
                "from_marker": pa.array(np.full(len(line), from_marker)),
                "line_no": of_items(numbers[line[:-1]], pa.int64()),
                "col": of_items(col, pa.int32()),
                "item_id": of_items(item, pa.int32()),
                "lowest": pa.array(lowest[line]),
                "base": pa.array(base[line]),
                "case_id": numbered(case_ids, case, case < 0, pa.int32()),
                "case_line": numbered(numbers, case, case < 0, pa.int64()),
                "plain": pa.array(plain),
                "inside": lists(named, inside),
                "first_line": at_end(int(numbers[0]), pa.int64()),
                "depth": at_end(int(depth[-1]), pa.int64()),
                "header": at_end(True if last_switch >= 0 else False if len(ups) else None, pa.bool_()),
                "pending": at_end(conditions[int(codes[last_if])].as_py() if last_if >= 0 else None, pa.string()),
                "pending_line": at_end(int(numbers[last_if]) if last_if >= 0 else None if len(ups) else -1, pa.int64()),
                "opened": lists(rest, opened),
            }
            return pa.table([columns[c] for c in names], names=names)

        found = []
        # The group's key is a hash, so a second file or block may share it.
        for file in table["file"].unique():
            lists = table.filter(pc.equal(table["file"], file))["lines"].combine_chunks()
            of_file = pa.Table.from_struct_array(lists.flatten())
            of_file = of_file.take(pc.sort_indices(of_file["line_no"]))
            blocks = np.floor_divide(of_file["line_no"].to_numpy(), block_lines)
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for first, stop in zip(cuts, cuts[1:]):
                part = of_file.slice(first, stop - first)
                found.append(scan(part, file, int(blocks[first]), False))
                starts = np.flatnonzero(part["is_start"].to_numpy())
                if len(starts):
                    found.append(scan(part.slice(starts[0]), file, int(blocks[first]), True))
        return pa.concat_tables(found)

    return read


def _carrier(schema: T.StructType):
    """The function that tells for each block of a file's lines what is open before it, from the marker until the scan stops."""
    names = schema.fieldNames()

    def carry(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, sort_keys=[("block", "ascending"), ("from_marker", "ascending")]))
        rows, marker, depth, stack, header, pending = [], None, 0, [], False, (None, None)
        for r in table.to_pylist():
            if r["from_marker"] != (marker is None):
                continue
            if marker is None:
                marker = r["first_line"]
            elif depth <= 0 and r["first_line"] > marker + 1:
                break  # what opens only after a gap behind the marker line does not count
            at = next((i for i, o in enumerate(stack) if o["is_switch"]), None)
            case = None if at is None else stack[at]["case_id"]
            rows.append((r["file"], r["block"], r["from_marker"], depth, header, *pending, 0 if at is None else at + 1, case, list(stack)))
            if depth + r["lowest"] <= 0:
                break
            kept = max(0, depth + r["base"])
            del stack[kept:]
            if stack and r["case_line"] is not None:
                stack[-1] = stack[-1] | {"case_id": r["case_id"], "case_line": r["case_line"]}
            for at, o in enumerate(r["opened"]):
                if o["if_line"] == -1:
                    o |= {"condition": pending[0], "if_line": pending[1]}
                if o["is_switch"] is None:
                    o["is_switch"] = header
                if depth + r["base"] + 1 + at >= 1:
                    stack.append(o)
            header = header if r["header"] is None else r["header"]
            pending = pending if r["pending_line"] == -1 else (r["pending"], r["pending_line"])
            depth += r["depth"]
        kinds = {n: table.schema.field(o).type for n, o in (("file", "file"), ("outer", "opened"), ("switch_case_id", "case_id"))}
        kinds |= {"from_marker": pa.bool_(), "header": pa.bool_(), "pending": pa.string()}
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.table({n: pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)})

    return carry


def _met(parsed: DataFrame, block_lines: int, fold: bool) -> DataFrame:
    """Items before the scan of their file stops, with what is open before their block of lines."""
    of_file = T.StructField("file", parsed.schema["file"].dataType)
    read_schema = T.StructType([of_file, *T.StructType.fromDDL(_READ).fields])
    carry_schema = T.StructType([of_file, *T.StructType.fromDDL(_CARRIED).fields])
    dealt = parsed.withColumn("key", F.xxhash64("file", F.expr(f"(line_no - pmod(line_no, {block_lines})) div {block_lines}")))
    # Lines are handed over as lists of some, several times as fast as one by one.
    some = F.expr(f"line_no div {_LINES_AT_ONCE}").alias("some")
    columns = [c for c in parsed.columns if c != "file"]
    listed = dealt.repartition("key").groupBy("key", "file", some).agg(F.collect_list(F.struct(*columns)).alias("lines"))
    found = materialize(listed.drop("some").groupBy("key").applyInArrow(_block_reader(read_schema, block_lines, fold), read_schema))
    ends = found.filter("depth IS NOT NULL")
    # One row per block of lines, stored: Spark sees how small it is.
    carried = materialize(ends.groupBy("file").applyInArrow(_carrier(carry_schema), carry_schema))
    names = {c: f"start_{c}" for c in ("depth", "header", "pending", "pending_line")}
    items = found.filter("depth IS NULL").drop("depth", "header", "pending", "pending_line", "first_line")
    return items.join(carried.withColumnsRenamed(names), ["file", "block", "from_marker"]).filter("start_depth + lowest > 0")


def _with_chain(met: DataFrame) -> DataFrame:
    """Items with the ``chain`` of blocks open before their line, outermost first."""
    kept = F.col("start_depth") + F.col("base")

    def latest(x: Column, at: Column) -> Column:
        here = (at == kept - 1) & F.col("case_line").isNotNull()
        return x.withField("case_id", F.when(here, F.col("case_id")).otherwise(x["case_id"])).withField(
            "case_line", F.when(here, F.col("case_line")).otherwise(x["case_line"])
        )

    def resolved(x: Column) -> Column:
        inherits = x["if_line"] == -1
        return F.struct(
            F.when(inherits, F.col("start_pending")).otherwise(x["condition"]).alias("condition"),
            F.when(inherits, F.col("start_pending_line")).otherwise(x["if_line"]).alias("if_line"),
            F.coalesce(x["is_switch"], F.col("start_header")).alias("is_switch"),
            x["case_id"].alias("case_id"),
            x["case_line"].alias("case_line"),
        )

    outer = F.transform(F.slice("outer", F.lit(1), F.greatest(kept, F.lit(0)).cast("int")), latest)
    def named(condition: Column) -> Column:
        """A plain block, which opens after every case of an outer block."""
        return F.struct(
            condition.alias("condition"), F.lit(_LAST).alias("if_line"), F.lit(False).alias("is_switch"),
            F.lit(None).cast("int").alias("case_id"), F.lit(None).cast("bigint").alias("case_line"),
        )

    # Blocks below depth zero enclose nothing.
    resolved_blocks = F.transform(F.filter("opened", lambda x, at: kept + at >= 0), resolved)
    inner = F.when(F.col("plain"), F.transform("inside", named)).otherwise(resolved_blocks)
    # An explosion of one, so that no filter on the chain is tested before those on the items.
    return met.select("file", "line_no", "col", "item_id", F.explode(F.array(F.concat(outer, inner))).alias("chain"))


def scoped_items(
    lines: DataFrame,
    start_marker: str = START_MARKER,
    switch_marker: str = SWITCH_MARKER,
    case_pattern: str = CASE_PATTERN,
    condition_pattern: str = IF_PATTERN,
    item_pattern: str = ITEM_PATTERN,
    block_lines: int = DEFAULT_BLOCK,
    fold: bool = False,
) -> DataFrame:
    """Every recorded item: (file, case_id, item_id, line_no, col, conditions).

    ``fold``: of the equal ones in a block of lines only the first, but for those whose switch opens there.
    """
    patterns = {"case": case_pattern, "if": condition_pattern, "item": item_pattern}
    met = _met(_parsed_lines(lines, start_marker, switch_marker, patterns), block_lines, fold)
    columns = ("file", "case_id", "item_id", "line_no", "col")
    # Most items stand in a switch that is the innermost block open around their lines: nothing is left to resolve.
    clear = F.col("plain") & (F.col("switch_at") > 0) & (F.col("start_depth") + F.col("base") == F.col("switch_at"))
    case_id = F.coalesce("case_id", "switch_case_id")
    easy = met.filter(clear).withColumn("case_id", case_id).filter("case_id > 0").select(*columns, F.col("inside").alias("conditions"))
    found = _with_chain(met.filter(~clear))
    # The outermost switch, and what is open inside it.
    at = F.array_position(F.transform("chain", lambda x: x["is_switch"]), F.lit(True)).cast("int")
    switch = F.try_element_at("chain", "at")
    inside = F.filter(
        F.slice("chain", F.col("at") + 1, F.size("chain")),
        lambda x: ~is_blank(x["condition"]) & (x["if_line"] >= F.col("case_line")),
    )
    return easy.unionByName(
        found.withColumn("at", at)
        .filter("at > 0")
        .select("*", switch["case_id"].alias("case_id"), switch["case_line"].alias("case_line"))
        .filter("case_id > 0")
        .select(*columns, F.transform(inside, lambda x: x["condition"]).alias("conditions"))
    )


def scoped_extract(lines: DataFrame, **options: object) -> DataFrame:
    """(file, case_id, item_id, conditions): one row per distinct item of a case."""
    # Repeats are folded before anything is gathered, so a block of lines adds each list of conditions once.
    items = scoped_items(lines, **options, fold=True)
    places = F.array_sort(F.collect_list(F.struct("line_no", "col", "conditions")))
    gathered = items.groupBy("file", "case_id", "item_id").agg(places.alias("places"))
    # A condition has the place where it is met first.
    return gathered.select(
        "file", "case_id", "item_id", F.array_distinct(F.flatten(F.col("places")["conditions"])).alias("conditions")
    )
