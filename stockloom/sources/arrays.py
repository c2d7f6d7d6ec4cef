"""JSON files whose top level is one array, read in splits.

A file is cut at every comma, wherever that stands, and the pieces of a split are read in their order. Whether a split
begins inside a string depends on the quotes of all splits before it, and how deep it begins on their brackets:
a first pass counts both, one row per split, for a start outside and inside a string, and these rows are added up. Then a second
pass knows where each split begins and joins the pieces of an element together again; an element begins where a piece
starts outside strings at depth one. Only the elements at the ends of a split meet their other parts in a shuffle. So no task
holds more than a batch of pieces and an element, and nothing is sorted; an element must fit a row.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, StringType, StructType

from stockloom.operators.scans import materialize
from stockloom.sources.tables import path_exists

# Functions are sent with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RECORDS = "pos BIGINT, is_object BOOLEAN, record VARIANT"


def read_json_array(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(records, load error).

    Records have the position in the array, whether the element is an object, and the element as a
    variant; an element that is no object is kept as ``{"_raw": element}``. A missing file, text that
    is no JSON and a top level that is no array give no records and an error text. A folder is read as
    the arrays of its files, one after the other by file name. The records are stored; a comma that ends
    the file after the array goes unnoticed.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    nothing = spark.createDataFrame([], _RECORDS)
    if not path_exists(spark, path):
        return nothing, f"missing file: {name}"
    pieces = spark.read.text(path, lineSep=",").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"), F.col("value").alias("piece")
    )
    splits = materialize(_splits(pieces))
    files = splits.filter("is_last")
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_array")).alias("other"), F.count_if("broken").alias("broken")).head()
    if seen["other"]:
        # No array to be cut into elements: the file is one value, as far as it is JSON.
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
        if whole.filter("doc IS NULL").isEmpty():
            return nothing, f"invalid json shape in {name}: expected array"
    if not seen["n"] or seen["other"] or seen["broken"]:
        return nothing, f"invalid json in {name}"
    records = _records(pieces, splits.filter("NOT empty"))
    if not records.filter("record IS NULL").isEmpty():
        return nothing, f"invalid json in {name}"
    return records, None


def _marks(text):
    """(commas, whether a string is open there, depth there, quotes, depth added) of joined pieces that begin outside strings."""
    import numpy as np

    data = np.frombuffer(text, np.uint8)
    plain = np.ones(len(data) + 1, bool)
    slashes = np.flatnonzero(data == ord("\\"))
    if len(slashes):
        # A character is escaped after an odd number of backslashes.
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        lengths = np.diff(first, append=len(slashes))
        plain[slashes[first + lengths - 1][lengths % 2 == 1] + 1] = False
    plain = plain[:-1]
    quotes = np.cumsum((data == ord('"')) & plain)
    folded = data | 32  # of brackets, the braces
    step = ((folded == ord("{")) & plain).astype(np.int64) - ((folded == ord("}")) & plain)
    inside = quotes % 2 == 1
    commas = np.flatnonzero(data == ord(","))
    outer, inner = np.cumsum(np.where(inside, 0, step)), np.cumsum(np.where(inside, step, 0))
    last = (int(quotes[-1]), int(outer[-1]), int(inner[-1])) if len(data) else (0, 0, 0)
    return commas, inside[commas], outer[commas], inner[commas], last


def _runs(batch, names):
    """(other columns, joined pieces) of the consecutive rows of a batch that agree in its first ``names`` columns; the pieces are its last one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    codes = [np.asarray(batch.column(k).dictionary_encode().indices) for k in range(names)]
    ends = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1 if batch.num_rows else []
    for start, end in zip([0, *ends], [*ends, batch.num_rows]):
        if start < end:
            texts = batch.column(batch.num_columns - 1).slice(start, end - start)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), texts), ",")
            yield tuple(batch.column(k)[int(start)].as_py() for k in range(batch.num_columns - 1)), joined[0].as_py().encode()


_SPLIT = "file string, split_start bigint, quotes bigint, outside bigint, inside bigint, low_outside bigint, low_inside bigint, head string, tail string, n_pieces bigint"


def _splits(pieces: DataFrame) -> DataFrame:
    """One row per split: how it begins, and on the last one of a file whether that is one closed array."""
    marks, runs, far = _marks, _runs, 1 << 40

    def count(batches):
        import pyarrow as pa

        key, sums = None, None

        def row():
            return pa.RecordBatch.from_pylist([{"file": key[0], "split_start": key[1]} | sums], schema)

        types = dict(split_start=pa.int64(), quotes=pa.int64(), outside=pa.int64(), inside=pa.int64(), low_outside=pa.int64(), low_inside=pa.int64())
        schema = pa.schema({"file": pa.string()} | types | {"head": pa.string(), "tail": pa.string(), "n_pieces": pa.int64()})
        for batch in batches:
            for found, text in runs(batch, 2):
                commas, inside, outer, inner, (quotes, out, within) = marks(text)
                head, tail = text.split(b",", 1)[0].decode(), text.rsplit(b",", 1)[-1].decode()
                if found != key:
                    if key is not None:
                        yield row()
                    # A split but the first of a file follows a comma.
                    low = far if found[1] == 0 else 0
                    key, sums = found, dict(quotes=0, outside=0, inside=0, low_outside=low, low_inside=far, head=head, tail="", n_pieces=0)
                elif sums["quotes"] % 2 == 0:
                    sums["low_outside"] = min(sums["low_outside"], sums["outside"])
                else:
                    sums["low_inside"] = min(sums["low_inside"], sums["inside"])
                if sums["quotes"] % 2 == 1:
                    inside, outer, inner, out, within = ~inside, inner, outer, within, out
                for name, depths in (("outside", outer[~inside]), ("inside", inner[inside])):
                    if len(depths):
                        sums[f"low_{name}"] = min(sums[f"low_{name}"], sums[name] + int(depths.min()))
                sums.update(quotes=sums["quotes"] + quotes, outside=sums["outside"] + out, inside=sums["inside"] + within)
                sums.update(tail=tail, n_pieces=sums["n_pieces"] + len(commas) + 1)
        if key is not None:
            yield row()

    in_order = Window.partitionBy("file").orderBy("split_start")
    before, whole = in_order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    counted = pieces.mapInArrow(count, _SPLIT).withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    placed = counted.withColumns(
        {c: F.when(F.col("in_string"), F.col(i)).otherwise(F.col(o)) for c, i, o in (("delta", "inside", "outside"), ("low", "low_inside", "low_outside"))}
    ).withColumns(
        {
            "depth": F.coalesce(F.sum("delta").over(before), F.lit(0)),
            "is_first": F.lag(F.lit(True)).over(in_order).isNull(),
            "is_last": F.lead(F.lit(True)).over(in_order).isNull(),
            "of_file": F.first("head").over(in_order),
        }
    )
    empty = (F.sum("n_pieces").over(whole) == 1) & F.rtrim(F.ltrim(_blanks(F.col("of_file")))).rlike(r"\A\[ *\]\z")
    unclosed = (F.sum("delta").over(whole) != 0) | (F.sum("quotes").over(whole) % 2 == 1) | (F.min(F.col("depth") + F.col("low")).over(whole) < 1)
    return placed.select(
        F.monotonically_increasing_id().alias("split"),
        "file",
        "split_start",
        "in_string",
        "depth",
        "is_first",
        "is_last",
        empty.alias("empty"),
        F.ltrim(_blanks(F.col("of_file"))).startswith("[").alias("is_array"),
        (unclosed | (F.col("is_last") & ~F.rtrim(_blanks(F.col("tail"))).endswith("]"))).alias("broken"),
    )


def _blanks(text: Column) -> Column:
    return F.translate(text, "\t\n\r", "   ")


def _elements(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, ordinal, whole, text): the elements that begin in a split from 1 on, and as 0 what it goes on with."""
    marks, runs = _marks, _runs

    def cut(batches):
        import re

        import numpy as np
        import pyarrow as pa

        names = ["split", "ordinal", "whole", "text"]
        key, ordinal, parts, quoted, depth = None, 0, [], False, 0

        def rows(first, texts, whole):
            n = len(texts)
            numbers = pa.array(np.arange(first, first + n), pa.int64())
            columns = [pa.array([key[0]] * n, pa.int64()), numbers, pa.array([whole] * n, pa.bool_()), pa.array(texts, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def rest():
            text = b",".join(parts)
            if key[4]:
                text = re.sub(rb"\][ \t\r\n]*\Z", b"", text)
            return rows(ordinal, [text], ordinal > 0 and key[4])

        for batch in batches:
            for found, text in runs(batch, 1):
                if found != key:
                    if key is not None and parts:
                        yield rest()
                    key, ordinal, parts, (quoted, depth) = found, 0, [], found[1:3]
                    if found[3]:
                        ordinal = 1
                commas, inside, outer, inner, (quotes, out, within) = marks(text)
                begins = not (found[3] and not parts and ordinal == 1) and not quoted and depth == 1
                if quoted:
                    inside, outer, out = ~inside, inner, within
                at = commas[~inside & (depth + outer == 1)].tolist()
                quoted, depth = (quotes % 2 == 1) != quoted, depth + out
                if key[3] and ordinal == 1 and not parts:
                    text = re.sub(rb"\A[ \t\r\n]*\[", b"", text).rjust(len(text))
                if begins:
                    if parts:
                        yield rows(ordinal, [b",".join(parts)], ordinal > 0)
                    ordinal, parts = ordinal + 1, []
                if at:
                    done = [b",".join([*parts, text[: at[0]]]), *(text[i + 1 : j] for i, j in zip(at, at[1:]))]
                    if ordinal == 0:
                        yield rows(0, done[:1], False)
                        if done[1:]:
                            yield rows(1, done[1:], True)
                    else:
                        yield rows(ordinal, done, True)
                    ordinal, parts, text = ordinal + len(at), [], text[at[-1] + 1 :]
                parts.append(text)
        if key is not None and parts:
            yield rest()

    known = splits.select("file", "split_start", "split", "in_string", "depth", "is_first", "is_last")
    # One row per split. The pieces must keep their order, so they may not be dealt out to meet it.
    met = pieces.join(F.broadcast(known), ["file", "split_start"])
    return met.select("split", "in_string", "depth", "is_first", "is_last", "piece").mapInArrow(cut, "split bigint, ordinal bigint, whole boolean, text string")


def _records(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """(pos, is_object, record); the record is null where an element is no JSON."""
    found = _elements(pieces, splits)
    text = F.col("text")
    stored = materialize(_parsed(found.withColumn("part", F.when(~F.col("whole"), text)), F.when(F.col("whole"), text), "split", "ordinal", "part"))
    # What stands at the end of a split goes on with the starts of those that follow.
    ends = stored.filter("part IS NOT NULL").join(splits.select("split", "file", "split_start"), "split")
    owner = F.last(F.when(F.col("ordinal") > 0, F.struct("split", "ordinal")), ignorenulls=True)
    so_far = Window.partitionBy("file").orderBy("split_start", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.array_sort(F.collect_list(F.struct("split_start", "ordinal", "part")))
    joined = (
        ends.select("file", "split_start", "ordinal", "part", owner.over(so_far).alias("owner"))
        .groupBy("owner")
        .agg(F.array_join(F.transform(parts, lambda p: p["part"]), ",").alias("text"))
        .select("owner.split", "owner.ordinal", "text")
    )
    joined = materialize(_parsed(joined, F.col("text"), "split", "ordinal"))
    begun = stored.groupBy("split").agg(F.max("ordinal").alias("n"))
    earlier = Window.orderBy("file", "split_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = begun.join(splits, "split").select("split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    elements = stored.filter("part IS NULL").drop("part").unionByName(joined)
    return elements.join(materialize(starts), "split").select((F.col("start") + F.col("ordinal") - 1).alias("pos"), "is_object", "record")


def _parsed(elements: DataFrame, text: Column, *keep: str) -> DataFrame:
    """``keep``, is_object, record: null where ``text`` is no JSON."""
    # The parser does not look beyond a value: with a bracket and with a brace around, it meets what follows.
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_field = F.try_parse_json(F.concat(F.lit('{"_raw":'), text, F.lit("}")))
    raw = F.when(in_list.isNotNull(), in_field)
    is_object = F.coalesce(F.ltrim(_blanks(text)).startswith("{"), F.lit(False))
    return elements.select(
        *keep, is_object.alias("is_object"), F.when(is_object, F.variant_get(raw, "$._raw", "variant")).otherwise(raw).alias("record")
    )


def _typed(value: Column, dtype: DataType, names: dict[str, dict[str, str]], field: str) -> Column:
    """A variant as ``dtype``, or null when it holds another type.

    A lenient get turns true, 2.0 and "5" into integers, so the stored type is tested first.
    """
    kind = F.schema_of_variant(value)
    if isinstance(dtype, StructType):
        return F.when(kind.startswith("OBJECT"), _struct(value, dtype, names, field))
    if isinstance(dtype, ArrayType):
        elements = F.try_variant_get(value, "$", "array<variant>")
        return F.transform(elements, lambda x: _typed(x, dtype.elementType, names, field))
    plain = F.try_variant_get(value, "$", dtype.simpleString())
    if isinstance(dtype, IntegralType):
        return F.when(kind == "BIGINT", plain)
    if isinstance(dtype, StringType):
        return F.when(kind == "STRING", plain)
    return plain


def _member(value: Column, dtype: DataType, names: dict[str, dict[str, str]], group: str, field: str):
    json_name = names.get(group, {}).get(field, field)
    return _typed(F.try_variant_get(value, f"$.{json_name}", "variant"), dtype, names, field)


def _struct(value: Column, dtype: StructType, names: dict[str, dict[str, str]], group: str) -> Column:
    return F.struct(
        *[_member(value, f.dataType, names, group, f.name).alias(f.name) for f in dtype.fields]
    )


def as_typed(
    records: DataFrame,
    schema: StructType,
    names: dict[str, dict[str, str]] | None = None,
    keep_record: bool = False,
) -> DataFrame:
    """(pos, is_object, typed columns[, record]) from variant records.

    ``names`` maps column -> JSON field, per nested column and under ``""`` for the top level; a
    missing entry means equal names. A field of another type becomes null, a list element of another
    type becomes a null element.
    """
    names = names or {}
    aliases = names.get("", {})
    # Members are taken out in a step of their own, as each is then used twice: for its type and for its value.
    members = {
        f"_m{i}": F.try_variant_get("record", f"$.{aliases.get(f.name, f.name)}", "variant") for i, f in enumerate(schema.fields)
    }
    return records.withColumns(members).select(
        "pos",
        "is_object",
        *[_typed(F.col(f"_m{i}"), f.dataType, names, f.name).alias(f.name) for i, f in enumerate(schema.fields)],
        *(["record"] if keep_record else []),
    )
