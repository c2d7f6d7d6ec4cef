"""Binary texture assets: header fields and the asset manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.names import (
    EDGE_ITEM_LABEL,
    NPC_ASSET_LABEL,
    fallback_label,
    resolve_name,
)
from stockloom.operators.lookups import lookup_left

# Fixed values of the container format.
MAGIC = b"XNB"
MIN_VERSION = 4
FLAG_COMPRESSED = 0x80
FLAG_LZ4 = 0x40
HEADER_BYTES = 10
TEXTURE_READER = "texture2dreader"
SURFACE_FORMATS = {0: "Color", 4: "Dxt1", 5: "Dxt3", 6: "Dxt5"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, and that the optimizer does not copy into it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _byte(data: Column, at: Column) -> Column:
    """Unsigned byte at a 1-based position; null past the end."""
    # One byte as text is one code unit below 128 only, so the value goes through hex digits.
    digit = F.hex(F.substring(data, at, F.lit(1)))
    return F.when(digit != "", F.conv(digit, 16, 10).cast("int"))


def _int32(data: Column, at: Column) -> Column:
    """Little-endian signed 32-bit integer; null past the end."""
    low, middle, high, top = (_byte(data, at + i).cast("bigint") for i in range(4))
    return _signed32(low + middle * 256 + high * 65_536 + top * 16_777_216)


def _signed32(unsigned: Column) -> Column:
    return _let(unsigned, lambda u: F.when(u >= 2**31, u - 2**32).otherwise(u))


def _varint(data: Column, at: Column) -> Column:
    """struct(value, next): 7-bit groups, low first, at most five; null when cut off or longer."""

    def value(groups: Column, n: Column) -> Column:
        shifted = F.transform(
            F.slice(groups, F.lit(1), n),
            lambda g, i: g.bitwiseAND(127).cast("bigint") * F.pow(F.lit(128), i).cast("bigint"),
        )
        total = F.aggregate(shifted, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return _signed32(total.bitwiseAND(2**32 - 1))

    def decode(groups: Column) -> Column:
        ends = F.transform(groups, lambda g: F.coalesce(g < 128, F.lit(False)))
        return _let(
            F.array_position(ends, True).cast("int"),
            lambda n: F.when(
                n > 0, F.struct(value(groups, n).alias("value"), (at + n).alias("next"))
            ),
        )

    return _let(
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: _byte(data, at + i)), decode
    )


def _reader_table(p: Column, count: Column, start: Column) -> Column:
    """struct(at, names) after the reader table; null when it is cut off."""

    def step(state: Column, _: Column) -> Column:
        def entry(size: Column) -> Column:
            # Name bytes, then a 4-byte version.
            end = (size["next"] + size["value"]).cast("int")
            name = F.substring(p, size["next"], size["value"].cast("int")).cast("string")
            return F.when(
                (size["value"] >= 0) & (end + 3 <= F.length(p)),
                F.struct(
                    (end + 4).alias("at"),
                    F.concat(state["names"], F.array(name)).alias("names"),
                ),
            )

        return _let(_varint(p, state["at"]), entry)

    first = F.struct(start.alias("at"), F.array().cast("array<string>").alias("names"))
    # A table cannot have more entries than bytes, which bounds the walk on damaged input.
    usable = (count > 0) & (count <= F.length(p))
    return F.when(usable, F.aggregate(F.sequence(F.lit(1), count.cast("int")), first, step))


def _mips_end(p: Column, mips: Column, start: Column) -> Column:
    """Position after the last mip level; null when one is cut off or has a negative length."""

    def step(at: Column, _: Column) -> Column:
        return _let(
            _int32(p, at),
            lambda size: F.when(
                (size >= 0) & (at + 4 + size - 1 <= F.length(p)), (at + 4 + size).cast("int")
            ),
        )

    usable = (mips > 0) & (mips <= F.length(p))
    return F.when(usable, F.aggregate(F.sequence(F.lit(1), mips.cast("int")), start, step))


_NO_FIELDS = {"surface_format": "int", "width": "int", "height": "int"}


def _outcome(error: Column, **values: Column) -> Column:
    """struct(surface_format, width, height, error); the fields are null when there is an error."""
    fields = [
        F.when(error.isNull(), values[n].cast(t)).alias(n) if n in values else F.lit(None).cast(t).alias(n)
        for n, t in _NO_FIELDS.items()
    ]
    return F.struct(*fields, error.alias("error"))


def _texture(p: Column, reader: Column, at: Column) -> Column:
    """Outcome of the texture fields, which start at ``at``."""

    def checked(t: Column) -> Column:
        across = F.ceil(t["width"] / 4) * F.ceil(t["height"] / 4)
        needed = (
            F.when(t["format"] == 0, t["width"] * t["height"] * 4)
            .when(t["format"] == 4, across * 8)
            .otherwise(across * 16)
        )
        error = (
            F.when(reader.isNull(), "invalid root reader")
            .when(~F.lower(reader).contains(TEXTURE_READER), "not a texture")
            .when(t["mips"].isNull(), "truncated")
            .when((t["width"] <= 0) | (t["height"] <= 0), "invalid dimensions")
            .when(t["mips"] <= 0, "no mip data")
            .when(t["mip0"] < 0, "negative mip length")
            .when(_mips_end(p, t["mips"], at + 16).isNull(), "truncated")
            .when(~t["format"].isin(list(SURFACE_FORMATS)), "unsupported surface format")
            .when(t["mip0"] < needed, "pixel data too short")
        )
        return _let(
            error,
            lambda e: _outcome(e, surface_format=t["format"], width=t["width"], height=t["height"]),
        )

    fields = ("format", "width", "height", "mips", "mip0")
    return _let(F.struct(*[_int32(p, at + 4 * i).alias(n) for i, n in enumerate(fields)]), checked)


def _payload(p: Column) -> Column:
    """Outcome of an uncompressed payload: reader table, root reader, texture."""

    def root_of(table: Column) -> Column:
        def described(root: Column) -> Column:
            index = root["value"].cast("int")
            known = (index > 0) & (index <= F.size(table["names"]))
            reader = F.when(known, F.get(table["names"], index - 1))
            return F.when(root.isNull(), _outcome(F.lit("truncated"))).otherwise(
                _let(reader, lambda r: _texture(p, r, root["next"]))
            )

        # One count of shared resources comes before the root's reader index.
        return _let(_let(_varint(p, table["at"]), lambda s: _varint(p, s["next"])), described)

    def tabled(readers: Column) -> Column:
        return (
            F.when(readers.isNull(), _outcome(F.lit("truncated")))
            .when(readers["value"] <= 0, _outcome(F.lit("no type readers")))
            .otherwise(_let(_reader_table(p, readers["value"], readers["next"]), root_of))
        )

    return _let(_varint(p, F.lit(1)), tabled)


def asset_header(files: DataFrame, content: str = "content") -> DataFrame:
    """Add surface_format, width, height, compressed and error (null when readable).

    Works on expressions only: bytes never leave the JVM, and ``content`` is not carried on.
    Compressed payloads are not decoded; they give the error ``compressed``.
    """
    others = [c for c in files.columns if c != content]

    def described(c: Column) -> Column:
        flags = _byte(c, F.lit(6))
        fixed = F.struct(
            F.coalesce(F.substring(c, 1, 3) == F.lit(MAGIC), F.lit(False)).alias("magic"),
            _byte(c, F.lit(5)).alias("version"),
            F.coalesce(flags.bitwiseAND(FLAG_COMPRESSED) != 0, F.lit(False)).alias("compressed"),
            F.coalesce(flags.bitwiseAND(FLAG_LZ4) != 0, F.lit(False)).alias("lz4"),
            _int32(c, F.lit(7)).alias("declared"),
        )
        return _let(fixed, lambda h: _with_compressed(h, _checked_header(c, h)))

    # A generator is a barrier: later filters on its columns do not repeat the parsing.
    return files.select(*others, F.inline(F.array(_let(F.col(content), described))))


def _with_compressed(h: Column, outcome: Column) -> Column:
    return _let(
        outcome,
        lambda o: F.struct(
            *[o[n].alias(n) for n in _NO_FIELDS],
            h["compressed"].alias("compressed"),
            o["error"].alias("error"),
        ),
    )


def _checked_header(c: Column, h: Column) -> Column:
    def fails(text: str) -> Column:
        return _outcome(F.lit(text))

    # The payload ends where the header says, if the file is that long.
    size, available = h["declared"] - HEADER_BYTES, F.length(c) - HEADER_BYTES
    length = F.when((size < 0) | (size > available), available).otherwise(size).cast("int")
    return (
        F.when(~h["magic"], fails("invalid magic"))
        .when(h["declared"].isNull(), fails("truncated"))
        .when(h["version"] < MIN_VERSION, fails("unsupported version"))
        .when(h["compressed"] & h["lz4"], fails("lz4 compressed"))
        .when(h["compressed"], fails("compressed"))
        .otherwise(_let(F.substring(c, F.lit(HEADER_BYTES + 1), length), _payload))
    )


def asset_names(assets: DataFrame, item_names: DataFrame) -> DataFrame:
    """Add internal_name: items look it up, with ``Item_<id>`` as fallback; others get ``NPC_<id>``."""
    joined = lookup_left(assets, item_names, {"id": "id"}, {"internal_name": "_lookup"})
    item_name = resolve_name(F.col("_lookup"), label=EDGE_ITEM_LABEL, id_col=F.col("id"))
    name = F.when(F.col("category") == "item", item_name).otherwise(
        fallback_label(NPC_ASSET_LABEL, F.col("id"))
    )
    return joined.withColumn("internal_name", name).drop("_lookup")


def described_assets(assets: DataFrame, item_names: DataFrame) -> DataFrame:
    """Assets (with ``content``) with header fields, name and error; unreadable ones included."""
    return asset_names(asset_header(assets), item_names)


def asset_manifest(assets: DataFrame, item_names: DataFrame) -> DataFrame:
    """Manifest rows of the readable assets; unordered, see :func:`manifest_order`."""
    return (
        described_assets(assets, item_names)
        .filter(F.col("error").isNull())
        .select(
            "id", "category", "internal_name", "sprite_file", "width", "height", "category_rank"
        )
    )


def manifest_order(manifest: DataFrame) -> DataFrame:
    """Items first, then by id; the path breaks ties."""
    return manifest.orderBy("category_rank", "id", "sprite_file")
