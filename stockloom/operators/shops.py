"""Vendor inventories from several sources of different trust."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.names import (
    UNLOCALIZED_PREFIX,
    VENDOR_ITEM_LABEL,
    VENDOR_LABEL,
    resolve_name,
)
from stockloom.functions.numbers import is_plausible_id
from stockloom.functions.text import special_currency_label
from stockloom.operators.dedupe import choose_source, ordered_distinct_list
from stockloom.operators.lookups import lookup_left
from stockloom.operators.nesting import DEFAULT_PART_WIDTH, nest_children
from stockloom.operators.scans import materialize

OFFER_FIELDS = ["item_id", "name", "buy_price", "conditions"]
# Priorities of the sources of one shop; ALWAYS keeps a sampled shop that found nothing at all.
RUNTIME, SECOND, PARSED, ALWAYS = 1, 2, 3, 9


def occupied_slots(slots: DataFrame) -> DataFrame:
    """Slots that hold a real item."""
    return slots.filter(F.col("item_id").isNotNull() & ~F.col("is_air") & (F.col("item_id") > 0))


def parsed_condition_lists(conditions: DataFrame) -> DataFrame:
    """(shop_id, item_id, parsed) from (shop_id, item_id, condition, ord...) rows."""
    order = [c for c in conditions.columns if c not in ("shop_id", "item_id", "condition")]
    return ordered_distinct_list(conditions, ["shop_id", "item_id"], "condition", order, "parsed")


def shop_items(slots: DataFrame, parsed: DataFrame) -> DataFrame:
    """One offer per (shop, item): name and price of the lowest slot, and its conditions.

    Slots are visited in order; each adds its currency label and then the parsed conditions, and
    repeats are ignored. So the list is: label of the first slot, parsed conditions, labels of later
    slots. Slots are first folded per (shop, item, currency), which bounds what is gathered by the
    number of currencies.
    """
    currency = F.when(F.col("special_currency") >= 0, F.col("special_currency"))
    folded = (
        occupied_slots(slots)
        .groupBy("shop_id", "item_id", currency.alias("currency"))
        .agg(
            F.min_by(F.struct("name", "buy_price"), "slot").alias("offer"),
            F.min("slot").alias("slot"),
        )
        .withColumn("label", special_currency_label(F.col("currency")))
    )
    offers = folded.groupBy("shop_id", "item_id").agg(
        F.min_by("offer", "slot").alias("offer"),
        F.array_sort(F.collect_list(F.struct("slot", "label"))).alias("labels"),
    )
    labels = F.transform("labels", lambda x: x["label"])
    ordered = F.concat(
        F.slice(labels, 1, 1),
        F.coalesce(F.col("parsed"), F.array().cast("array<string>")),
        labels,
    )
    return offers.join(parsed, ["shop_id", "item_id"], "left").select(
        "shop_id",
        "item_id",
        F.col("offer")["name"].alias("name"),
        F.col("offer")["buy_price"].alias("buy_price"),
        F.array_distinct(F.array_compact(ordered)).alias("conditions"),
    )


def offer_names(offers: DataFrame, internal_names: DataFrame) -> DataFrame:
    """Resolve each offer's name: usable name, internal name, ``Item <id>``."""
    joined = lookup_left(
        offers, internal_names, {"item_id": "id"}, {"internal_name": "_internal"}
    )
    name = resolve_name(
        F.col("name"),
        F.col("_internal"),
        label=VENDOR_ITEM_LABEL,
        id_col=F.col("item_id"),
        bad_prefix=UNLOCALIZED_PREFIX,
    )
    return joined.withColumn("name", name).drop("_internal")


def sampled_items(rolls: DataFrame) -> DataFrame:
    """(shop_id, item_id) seen in any sample; ``rolls`` carries shop_id, sample, item_id."""
    ids = rolls.select("shop_id", "sample", F.col("item_id").try_cast("int").alias("item_id"))
    return ids.filter(F.col("item_id") > 0).select("shop_id", "item_id").distinct()


def plausible_constants(constants: DataFrame, id_count: int) -> DataFrame:
    """(shop_id, item_id) constants that look like stock ids."""
    return constants.filter(is_plausible_id(F.col("item_id"), F.lit(id_count))).distinct()


def shop_offers(
    slots: DataFrame,
    parsed_items: DataFrame,
    parsed: DataFrame,
    second_items: DataFrame,
    rolls: DataFrame,
    constants: DataFrame,
    item_defaults: DataFrame,
    shop_map: DataFrame,
    id_count: int,
    runtime_ok: DataFrame | None = None,
) -> DataFrame:
    """Offers of every source with their priority; nothing is chosen yet.

    Sampled shops use rolls and constants only; the second source exists only for flagged shops. With
    ``runtime_ok``, (shop_id, ok), no offers are made that cannot be chosen: those of a runtime source that
    failed, and of the sources after one that succeeded.
    """
    kinds = shop_map.select("shop_id", "sampled", "has_second_source")
    plain = kinds.filter(~F.col("sampled"))
    later = plain
    if runtime_ok is not None:
        # Stored, one row per shop: Spark sees its size, and slots need not move to meet it.
        first = materialize(plain.join(runtime_ok.filter("ok"), "shop_id", "left_semi"))
        later = materialize(plain.join(first, "shop_id", "left_anti"))
        plain = first
    no_conditions = F.array().cast("array<string>")

    def from_ids(ids: DataFrame, priority: int, sampled: bool, *, with_parsed: bool) -> DataFrame:
        wanted = kinds.filter(F.col("sampled")) if sampled else later
        if priority == SECOND and not sampled:
            wanted = wanted.filter(F.col("has_second_source"))
        rows = ids.join(wanted.select("shop_id"), "shop_id", "left_semi")
        rows = lookup_left(
            rows, item_defaults, "item_id", {"name": "name", "buy_price": "buy_price"}
        )
        if with_parsed:
            rows = rows.join(parsed, ["shop_id", "item_id"], "left")
            conditions = F.coalesce(F.col("parsed"), no_conditions)
        else:
            conditions = no_conditions
        return rows.select(
            "shop_id",
            F.lit(priority).alias("priority"),
            "item_id",
            "name",
            "buy_price",
            conditions.alias("conditions"),
        )

    runtime = shop_items(slots.join(plain.select("shop_id"), "shop_id", "left_semi"), parsed).select(
        "shop_id", F.lit(RUNTIME).alias("priority"), *OFFER_FIELDS
    )
    return (
        runtime.unionByName(from_ids(second_items, SECOND, False, with_parsed=False))
        .unionByName(from_ids(parsed_items, PARSED, False, with_parsed=True))
        .unionByName(from_ids(sampled_items(rolls), RUNTIME, True, with_parsed=False))
        .unionByName(
            from_ids(plausible_constants(constants, id_count), SECOND, True, with_parsed=False)
        )
    )


def shop_status(offers: DataFrame, shop_map: DataFrame, runtime_ok: DataFrame) -> DataFrame:
    """(shop_id, priority, ok, n_rows): what each source delivered for each shop.

    ``runtime_ok`` holds (shop_id, ok) of the runtime source. A sampled shop needs rows to use its
    rolls, and is kept in any case.
    """
    counts = offers.groupBy("shop_id", "priority").agg(F.count("*").alias("n_rows"))
    with_rows = counts.select("shop_id", "priority", F.lit(True).alias("ok"), "n_rows")
    succeeded = (
        shop_map.filter(~F.col("sampled"))
        .join(runtime_ok.filter("ok"), "shop_id", "left_semi")
        .select(
            "shop_id", F.lit(RUNTIME).alias("priority"), F.lit(True).alias("ok"),
            F.lit(0).cast("bigint").alias("n_rows"),
        )
    )
    failed = shop_map.join(runtime_ok.filter("ok"), "shop_id", "left_anti").filter(~F.col("sampled"))
    # Rows of a runtime source that failed must not count.
    usable = with_rows.join(
        failed.select("shop_id", F.lit(RUNTIME).alias("priority")), ["shop_id", "priority"], "left_anti"
    )
    always = shop_map.filter("sampled").select(
        "shop_id", F.lit(ALWAYS).alias("priority"), F.lit(True).alias("ok"),
        F.lit(1).cast("bigint").alias("n_rows"),
    )
    return usable.unionByName(succeeded).unionByName(always)


def shop_catalog(
    shop_map: DataFrame,
    slots: DataFrame,
    runtime_ok: DataFrame,
    parsed_items: DataFrame,
    conditions: DataFrame,
    second_items: DataFrame,
    rolls: DataFrame,
    constants: DataFrame,
    item_defaults: DataFrame,
    internal_names: DataFrame,
    npc_names: DataFrame,
    id_count: int,
    part_width: int = DEFAULT_PART_WIDTH,
) -> DataFrame:
    """Shop rows with nested offers sorted by item id, from the best source of each shop.

    A shop whose first source succeeded stays even when empty; a shop with no usable source is
    absent; a sampled shop always stays. Materialises the offers of all sources.
    """
    parsed = parsed_condition_lists(conditions)
    # Read three times below (counts, rows, headers), so computed and written once.
    offers = materialize(
        shop_offers(
            slots, parsed_items, parsed, second_items, rolls, constants, item_defaults, shop_map, id_count, runtime_ok
        )
    )
    chosen = choose_source(shop_status(offers, shop_map, runtime_ok), ["shop_id"], empty_wins_at=RUNTIME)
    rows = offer_names(
        offers.join(chosen, ["shop_id", "priority"], "left_semi"), internal_names
    )
    nested = nest_children(
        chosen.select("shop_id"), rows, ["shop_id"], "item_id", OFFER_FIELDS, "items", part_width
    )
    shops = lookup_left(nested, shop_map, "shop_id", {"npc_id": "npc_id", "shop_name": "shop_name"})
    return with_npc_names(shops, npc_names).select(
        "shop_id", "npc_id", "npc_name", "shop_name", "part", "items"
    )


def with_npc_names(shops: DataFrame, npc_names: DataFrame) -> DataFrame:
    """Vendor name: localized, internal, ``NPC <id>``."""
    columns = {c: f"_{c}" for c in ("name", "internal_name") if c in npc_names.columns}
    joined = lookup_left(shops, npc_names, "npc_id", columns)
    name = resolve_name(
        *[F.col(c) for c in columns.values()], label=VENDOR_LABEL, id_col=F.col("npc_id")
    )
    return joined.withColumn("npc_name", name).drop(*columns.values())


__all__ = [
    "occupied_slots",
    "offer_names",
    "parsed_condition_lists",
    "plausible_constants",
    "sampled_items",
    "shop_catalog",
    "shop_items",
    "shop_offers",
    "shop_status",
    "with_npc_names",
]
