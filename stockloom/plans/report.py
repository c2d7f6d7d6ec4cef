"""Reports of a validation and of a run.

Failing references and manifest rows can be many: all of them are written by the executors as JSON lines
beside the report, and the report names the folder and their number. Other failures are as few as checks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stockloom.plans.catalog import Phase, run_catalog
from stockloom.plans.validation import Validation, validate_catalog
from stockloom.sinks.text import write_text_file


def _rows(df: DataFrame, *order: str) -> list[dict[str, object]]:
    """Rows of a frame whose size is fixed by the number of checks."""
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def _store(df: DataFrame, path: str) -> dict[str, object]:
    """Write all rows as JSON lines; (path, count). The count comes with the write."""
    seen = Observation(path)
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return {"path": path, "count": seen.get["n"]}


def _section(passed: bool, details: object, failing: object, **more: object) -> dict[str, object]:
    return {"pass": passed, "details": details, "failingRecords": failing, **more}


def build_report(
    spark: SparkSession, folder: str, result: Validation, tables: str
) -> dict[str, object]:
    """The report as plain values. All failing references and manifest rows are written under ``tables``.

    The keys of the report are fixed values.
    """
    foreign = _store(result.foreign_keys, f"{tables}/foreign_keys")
    manifest = _store(result.manifest, f"{tables}/manifest")
    ranges = _rows(result.ranges, "check")
    spots = _rows(result.spots, "check")
    counts = {r["metric"]: r["actual"] for r in _rows(result.counts)}
    required = _rows(result.required)
    required_failures = _rows(result.required_failures)

    def brief(test: Callable[[dict[str, object]], bool]) -> list[dict[str, object]]:
        return [{k: r[k] for k in ("check", "expected", "actual")} for r in ranges if test(r)]

    n_foreign, n_manifest = foreign["count"], manifest["count"]
    checks = {
        "required_files": _section(not required_failures, required, required_failures),
        "count_ranges": _section(
            all(r["pass"] for r in ranges),
            ranges,
            brief(lambda r: not r["pass"]),
            warningRecords=brief(lambda r: bool(r["warning"])),
        ),
        "foreign_key_integrity": _section(
            n_foreign == 0,
            {
                "checkedDatasets": ["recipes", "shimmer", "npc_shops", "sprite_manifest"],
                "validItemIdCount": result.item_ids.head()["n_ids"],
                "invalidReferenceCount": n_foreign,
            },
            foreign,
        ),
        "sprite_manifest_integrity": _section(
            n_manifest == 0,
            {
                "checkedRows": counts["sprite_manifest_range"],
                "failureCount": n_manifest,
            },
            manifest,
        ),
        "spot_checks": _section(
            all(r["pass"] for r in spots),
            [{**r, "evidence": json.loads(r["evidence"]) if r["evidence"] else None} for r in spots],
            [{"check": r["check"], "required": r["required"]} for r in spots if not r["pass"]],
        ),
    }
    return {
        "status": "PASS" if all(section["pass"] for section in checks.values()) else "FAIL",
        "outputDirectory": folder,
        "counts": {
            "items": counts["items_range"],
            "recipes": counts["recipes_range"],
            "shimmer": counts["shimmer_total"],
            "npc_shops": counts["npc_shops_min"],
            "sprite_manifest": counts["sprite_manifest_range"],
            "shimmerTypeBreakdown": {
                "item_transform": counts["shimmer_item_transform_range"],
                "deconstruct": counts["shimmer_deconstruct_range"],
            },
            "spriteCategoryBreakdown": {
                "item": counts["sprite_items_min"],
                "npc": counts["sprite_npcs_min"],
            },
        },
        "checks": checks,
    }


@dataclass
class _Page:
    lines: list[str] = field(default_factory=list)

    def add(self, *lines: str) -> None:
        self.lines += lines

    def records(self, title: str, records: object) -> None:
        if not records or isinstance(records, dict) and not records["count"]:
            self.add(f"- {title}: none")
            return
        if isinstance(records, dict):
            self.add(f"- {title}: {records['count']}, all of them in `{records['path']}`")
            return
        self.add(f"- {title}:", "", "```json", json.dumps(records, indent=2, sort_keys=True), "```")


# Section keys with their titles, in report order.
SECTION_TITLES: tuple[tuple[str, str], ...] = (
    ("required_files", "Required files exist"),
    ("count_ranges", "Count ranges"),
    ("foreign_key_integrity", "Foreign-key integrity"),
    ("sprite_manifest_integrity", "Sprite manifest integrity"),
    ("spot_checks", "Spot checks"),
)


def markdown_report(report: dict[str, object]) -> str:
    """The report as Markdown with LF line ends."""
    page = _Page()
    counts, checks = report["counts"], report["checks"]
    page.add("# Validation Report", "", f"- Status: {report['status']}")
    page.add(f"- Output directory: `{report['outputDirectory']}`", "", "## Counts", "")
    for name, value in counts.items():
        if isinstance(value, dict):
            value = ", ".join(f"`{k}={v}`" for k, v in value.items())
        page.add(f"- {name}: {value}")
    page.add("", "## Check Results")
    for number, (key, title) in enumerate(SECTION_TITLES, 1):
        section = checks[key]
        page.add("", f"### {number}) {title}", f"- Result: {'PASS' if section['pass'] else 'FAIL'}")
        details = section["details"]
        if key == "count_ranges":
            for d in details:
                page.add(f"- {d['check']} (expected `{d['expected']}`): {d['status']} (actual `{d['actual']}`)")
            page.records("Warning records", section["warningRecords"])
        elif key == "spot_checks":
            for d in details:
                shown = json.dumps(d["evidence"]) if d["evidence"] else d["required"]
                page.add(f"- {d['check']}: {'PASS' if d['pass'] else 'FAIL'} (`{shown}`)")
        elif isinstance(details, dict):
            for name, value in details.items():
                page.add(f"- {name}: `{value}`")
        else:
            page.add(*[f"- `{d['file']}`: {'present' if d['exists'] else 'missing'}" for d in details])
        page.records("Failing records", section["failingRecords"])
    page.add("", "## Notes", "", "- A count above its soft maximum is a warning and does not fail the run.")
    return "\n".join(page.lines) + "\n"


def write_reports(spark: SparkSession, report: dict[str, object], json_path: str, md_path: str) -> None:
    write_text_file(spark, json_path, json.dumps(report, indent=2) + "\n")
    write_text_file(spark, md_path, markdown_report(report))


def run_validation(
    spark: SparkSession, folder: str, json_path: str, md_path: str
) -> bool:
    """Validate the datasets in ``folder`` and write both reports; True on PASS."""
    report = build_report(spark, folder, validate_catalog(spark, folder), f"{json_path}.tables")
    write_reports(spark, report, json_path, md_path)
    return report["status"] == "PASS"


def run_and_validate(
    spark: SparkSession,
    phases: list[Phase],
    folder: str,
    json_path: str | None = None,
    md_path: str | None = None,
) -> bool:
    """Run the phases, then validate when report paths are given; stops at the first failing stage."""
    if not run_catalog(spark, phases, folder):
        return False
    if json_path is None or md_path is None:
        return True
    return run_validation(spark, folder, json_path, md_path)


def phase_summary(run_log: DataFrame) -> DataFrame:
    """One line per run and phase: outcome, rows, file names, seconds, errors."""
    return run_log.select(
        "run_id",
        "phase_name",
        F.when(F.col("succeeded"), "PASS").otherwise("FAIL").alias("outcome"),
        "row_count",
        F.element_at(F.split("json_path", "/"), -1).alias("json_file"),
        F.element_at(F.split("csv_path", "/"), -1).alias("csv_file"),
        F.round(F.col("elapsed_ms") / 1000, 2).alias("seconds"),
        "errors",
    )


def phase_totals(run_log: DataFrame) -> DataFrame:
    """(run_id, n_passed, n_failed): one row per run."""
    return run_log.groupBy("run_id").agg(
        F.count_if(F.col("succeeded")).alias("n_passed"),
        F.count_if(~F.col("succeeded")).alias("n_failed"),
    )
