"""Data-quality checks. Each gives a DataFrame of violations or of check results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.scans import materialize

FK_COLUMNS = ["dataset", "record_id", "field", "ref_id", "element_index"]


# --- referential integrity --------------------------------------------------------------------


def fk_violations(
    child: DataFrame,
    fk: Column,
    parent: DataFrame,
    pk: str,
    dataset: str,
    field: str | Column,
    record_id: Column,
    element_index: Column | None = None,
    exempt: Column | None = None,
    parent_unique: bool = True,
    dangling: DataFrame | None = None,
) -> DataFrame:
    """References without a parent; a null reference is a violation.

    Rows marked ``exempt`` are not checked. With ``parent_unique`` false the parent ids are reduced
    first and stored, so that the join has a shuffle of its own, which adaptive execution can split.

    Only the columns of the result and the key are shuffled. A hot key sits on the probe side of an
    anti join; the parent side holds each id once. With ``dangling``, the result of :func:`dangling_ids`
    for these references, the parent is not read again: rows are picked by the ids that it names, and
    what describes a violation is computed for violations only.
    """
    rows = child if exempt is None else child.filter(~F.coalesce(exempt, F.lit(False)))
    index = F.lit(None) if element_index is None else element_index
    if dangling is not None:
        named = dangling.select(F.col("ref_id").alias("_dangling"))
        picked = rows.withColumn("_ref", fk.cast("bigint")).join(named, F.col("_ref").eqNullSafe(F.col("_dangling")), "left_semi")
        return picked.select(
            F.lit(dataset).alias("dataset"),
            record_id.cast("string").alias("record_id"),
            (F.lit(field) if isinstance(field, str) else field).alias("field"),
            F.col("_ref").alias("ref_id"),
            index.cast("int").alias("element_index"),
        )
    probe = rows.select(
        F.lit(dataset).alias("dataset"),
        record_id.cast("string").alias("record_id"),
        (F.lit(field) if isinstance(field, str) else field).alias("field"),
        fk.cast("bigint").alias("ref_id"),
        index.cast("int").alias("element_index"),
    )
    ids = valid_ids(parent, pk)
    ids = ids if parent_unique else materialize(ids.distinct())
    return probe.join(ids, "ref_id", "left_anti").select(*FK_COLUMNS)


def valid_ids(parent: DataFrame, pk: str) -> DataFrame:
    return (
        parent.select(F.col(pk).cast("bigint").alias("ref_id")).filter(F.col("ref_id").isNotNull())
    )


def dangling_ids(references: Sequence[tuple[DataFrame, Column]], parent: DataFrame, pk: str) -> DataFrame:
    """(ref_id): each id that one of the references (frame, list of ids) holds and the parent lacks, null included.

    Repeats collapse before the shuffle, so that ids alone are moved. The result is stored: Spark sees its size.
    """
    found: DataFrame | None = None
    for frame, ids in references:
        part = frame.select(F.explode(ids.cast("array<bigint>")).alias("ref_id"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no references given")
    return materialize(found.distinct().join(valid_ids(parent, pk), "ref_id", "left_anti"))


def fk_violation_counts(
    child: DataFrame, fk: str, parent: DataFrame, pk: str, out: str = "n_rows"
) -> DataFrame:
    """(ref_id, number of rows) of every dangling reference; null references are one group.

    Rows are counted per reference before the join, so a hot reference is one row when it meets the
    parent.
    """
    counts = child.groupBy(F.col(fk).cast("bigint").alias("ref_id")).agg(F.count("*").alias(out))
    return counts.join(valid_ids(parent, pk), "ref_id", "left_anti")


def fk_violations_nested(
    child: DataFrame,
    arr: str,
    fk: str | None,
    parent: DataFrame,
    pk: str,
    dataset: str,
    field: str,
    record_id: Column,
    dangling: DataFrame | None = None,
) -> DataFrame:
    """As :func:`fk_violations` for the elements of a list, with their 0-based position.

    ``fk`` names the field inside a struct element; None takes the element itself. A null list has
    no elements; a null element is a violation with a null reference, reported for the list itself.
    """
    if dangling is not None:
        each = child.select("*", F.posexplode(arr).alias("_pos", "_el"))
        ref = F.col("_el") if fk is None else F.col("_el")[fk]
        label = field if fk is None else F.when(F.col("_el").isNull(), f"{arr}[]").otherwise(field)
        return fk_violations(
            each, ref, parent, pk, dataset, label, record_id, element_index=F.col("_pos"), dangling=dangling
        )
    elements = child.select(record_id.cast("string").alias("_rid"), F.posexplode(arr).alias("_pos", "_el"))
    ref = F.col("_el") if fk is None else F.col("_el")[fk]
    label = field if fk is None else F.when(F.col("_el").isNull(), f"{arr}[]").otherwise(field)
    return fk_violations(
        elements, ref, parent, pk, dataset, label, F.col("_rid"), element_index=F.col("_pos")
    )


def union_failures(*failures: DataFrame) -> DataFrame:
    """All failures in the order given, marked by ``section_rank``."""
    out: DataFrame | None = None
    for rank, part in enumerate(failures):
        ranked = part.withColumn("section_rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        raise ValueError("no failure streams given")
    return out


def contains_all_rows(
    df: DataFrame, keys: Sequence[str], value: str, required: Sequence[int]
) -> DataFrame:
    """Keys whose rows hold every required value: the flat form of ``contains_all``.

    Only matching rows are read on, and repeats collapse before the shuffle; then values are counted.
    """
    wanted = sorted(set(required))
    return (
        df.filter(F.col(value).isin(wanted))
        .select(*keys, value)
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == len(wanted))
        .select(*keys)
    )


def missing_files(manifest: DataFrame, path: Column, listing: DataFrame) -> DataFrame:
    """Rows whose file is not in the listing (``path`` column), by anti join."""
    present = listing.select(F.col("path").alias("_path")).distinct()
    return manifest.withColumn("_path", path).join(present, "_path", "left_anti").drop("_path")


# --- row rules ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``broken`` marks a violation; ``value`` is what the record held."""

    field: str
    error: str | Column
    broken: Column
    value: Column


def row_rules(df: DataFrame, record_id: Column, rules: Sequence[Rule]) -> DataFrame:
    """(record_id, field, error, value): one row per broken rule, in one pass without a shuffle."""
    entries = [
        F.when(
            F.coalesce(rule.broken, F.lit(False)),
            F.struct(
                F.lit(rule.field).alias("field"),
                (F.lit(rule.error) if isinstance(rule.error, str) else rule.error).alias("error"),
                rule.value.cast("string").alias("value"),
            ),
        )
        for rule in rules
    ]
    broken = F.array_compact(F.array(*entries))
    return df.select(record_id.alias("record_id"), F.explode(broken).alias("_f")).select(
        "record_id", "_f.*"
    )


# --- counts and ranges -------------------------------------------------------------------------


@dataclass(frozen=True)
class RangeCheck:
    """Hard minimum and optional soft maximum for a count."""

    name: str
    minimum: int
    soft_max: int | None = None

    @property
    def expected(self) -> str:
        return f">={self.minimum}" if self.soft_max is None else f"{self.minimum}-{self.soft_max}"


def check_status(passed: Column, warning: Column) -> Column:
    return F.when(~passed, "FAIL").when(warning, "WARN").otherwise("PASS")


def count_metrics(df: DataFrame, metrics: dict[str, Column | None]) -> DataFrame:
    """(metric, actual): counts of rows meeting each condition (None counts all), in one scan."""
    counts = df.agg(
        *[
            (F.count("*") if condition is None else F.count_if(condition)).alias(f"_{i}")
            for i, condition in enumerate(metrics.values())
        ]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(f"_{i}").alias("actual"))
            for i, m in enumerate(metrics)
        ]
    )
    return counts.select(F.explode(pairs).alias("p")).select("p.metric", "p.actual")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(metric, actual): number of rows per dataset."""
    out: DataFrame | None = None
    for name, df in tables.items():
        part = count_metrics(df, {name: None})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no datasets given")
    return out


def count_by_type(df: DataFrame, type_col: Column, expected: Sequence[str]) -> DataFrame:
    """(type, n) for the expected types over trimmed values; an absent type counts 0."""
    counts = df.agg(
        *[F.count_if(F.coalesce(type_col, F.lit("")) == t).alias(f"_{i}") for i, t in enumerate(expected)]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(t).alias("type"), F.col(f"_{i}").alias("n"))
            for i, t in enumerate(expected)
        ]
    )
    return counts.select(F.explode(pairs).alias("p")).select("p.type", "p.n")


def count_range(metrics: DataFrame, checks: Sequence[RangeCheck]) -> DataFrame:
    """(check, expected, actual, pass, warning, status) from (metric, actual) rows.

    Below the minimum fails; above the soft maximum only warns.
    """
    rules = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("check"),
                F.lit(c.expected).alias("expected"),
                F.lit(c.minimum).cast("bigint").alias("minimum"),
                F.lit(c.soft_max).cast("bigint").alias("soft_max"),
            )
            for c in checks
        ]
    )
    # The rules travel as a literal array; each metric picks its own, so no join is needed.
    mine = F.filter(rules, lambda r: r["check"] == F.col("metric"))
    joined = metrics.select(F.explode(mine).alias("r"), "actual")
    passed = F.col("actual") >= F.col("r.minimum")
    warning = F.coalesce(F.col("actual") > F.col("r.soft_max"), F.lit(False))
    return joined.select(
        "r.check",
        "r.expected",
        "actual",
        passed.alias("pass"),
        warning.alias("warning"),
        check_status(passed, warning).alias("status"),
    )


def distinct_valid_ids(df: DataFrame, id_col: str, out: str = "n_ids") -> DataFrame:
    return df.agg(F.count_distinct(id_col).alias(out))


# --- overall status ----------------------------------------------------------------------------


def section_result(section: str, failures: DataFrame) -> DataFrame:
    """(section, n_failures, pass) of one section."""
    return failures.agg(F.count("*").alias("n_failures")).select(
        F.lit(section).alias("section"), "n_failures", (F.col("n_failures") == 0).alias("pass")
    )


def overall_status(sections: DataFrame) -> DataFrame:
    """(status, n_passed, n_failed): PASS when every section passes; warnings do not count."""
    passed = F.coalesce(F.bool_and("pass"), F.lit(True))
    return sections.agg(
        F.when(passed, "PASS").otherwise("FAIL").alias("status"),
        F.count_if(F.col("pass")).alias("n_passed"),
        F.count_if(~F.col("pass")).alias("n_failed"),
    )


# --- batch progress ----------------------------------------------------------------------------


def progress_counters(df: DataFrame, error: str = "error") -> DataFrame:
    """(processed, saved, failed) of a batch whose row errors are tolerated."""
    return df.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col(error).isNull()).alias("saved"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
    )


# --- spot checks -------------------------------------------------------------------------------


def spot_check(name: str, evidence: DataFrame, required: str) -> DataFrame:
    """(check, pass, evidence, required) from a frame with at most one evidence row."""
    found = evidence.agg(
        F.count("*").alias("_n"), F.any_value(F.to_json(F.struct(*evidence.columns))).alias("evidence")
    )
    return found.select(
        F.lit(name).alias("check"),
        (F.col("_n") > 0).alias("pass"),
        "evidence",
        F.lit(required).alias("required"),
    )
