"""The whole analysis as one job: listings file in, clean table, reports and dashboard out.

    spark-submit --py-files shelfscan.zip shelfscan/plans/job.py listings.csv /shared/out
"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from shelfscan import schema
from shelfscan.operators import cleaning, marts, quality
from shelfscan.operators.cube import stock_cube
from shelfscan.plans import reports
from shelfscan.sources import listings, sinks, versions
from shelfscan.sources.workspace import materialize, scratch


def _split(group: dict[str, reports.Operator]) -> tuple[dict[str, quality.Summary], dict[str, reports.Operator]]:
    """The reports that can share a scan, and the others."""
    together = {name: operator for name, operator in group.items() if isinstance(operator, quality.Summary)}
    return together, {name: operator for name, operator in group.items() if name not in together}


def _run(spark: SparkSession, csv: str, out: str, encoding: str, fmt: str) -> dict[str, versions.Table]:
    """Write everything under ``out``."""

    def stored(df: DataFrame, name: str) -> versions.Table:
        return versions.table(lambda: df)(f"{out}/{name}")

    def observed(df: DataFrame, name: str, summaries: dict[str, quality.Summary]):
        return quality.summarise_while(df, summaries, lambda seen: stored(seen, name))

    with scratch(spark):
        audits, other_audits = _split(reports.AUDIT)
        raw_table, audited = observed(listings.read_strict(spark, csv, encoding), "raw", audits)
        raw = spark.read.schema(schema.RAW).parquet(raw_table.folder)
        repeated = materialize(other_audits.pop("c10_duplicate_keys")(raw), "repeated_keys")
        quality.require_valid_keys(audited["c05_null_audit"], repeated)

        validations, other_validations = _split(reports.VALIDATION)
        clean_table, validated = observed(cleaning.clean(raw), "clean", validations)
        clean = spark.read.schema(schema.CLEAN).parquet(clean_table.folder)
        dashboard_table = stored(cleaning.clean_for_dashboard(raw), "dashboard_listings")
        dashboard = spark.read.schema(schema.CLEAN).parquet(dashboard_table.folder)

        cube = materialize(stock_cube(clean), "cube")
        counts = materialize(quality.category_counts(raw), "category_counts")
        ready = {**audited, "c10_duplicate_keys": repeated, **validated}
        tables = {name: partial(lambda df: df, df) for name, df in ready.items()}
        for name, operator in other_audits.items():
            tables[name] = partial(operator, counts if name in reports.FROM_CATEGORY_COUNTS else raw)
        for group in (other_validations, reports.EXPLORATION, reports.BUSINESS, reports.FINDINGS):
            for name, operator in group.items():
                tables[name] = partial(operator, clean if name in reports.FROM_LISTINGS else cube)
        writers = {name: partial(versions.table(build, fmt), f"{out}/reports/{name}") for name, build in tables.items()}
        for name, write in marts.mart_writers(dashboard, fmt, all_rows=False).items():
            writers[f"dashboard_{name}"] = partial(write, f"{out}/dashboard/{name}")
        return {"raw": raw_table, "clean": clean_table, "dashboard_all_rows": dashboard_table, **sinks.run_all(writers)}


def run(spark: SparkSession, csv: str, out: str, encoding: str = "UTF-8", fmt: str = "parquet") -> dict[str, str]:
    """Load, audit, clean, analyse and build the dashboard tables; returns name -> path.

    The raw, clean and dashboard tables are stored before anything reads them, so each is made
    once, and a rerun replaces what an earlier one left, table by table. Reports of plain
    aggregates are gathered while their table is written, without a scan of their own, and those
    that a cube of the clean listings can answer read that. The keys are checked by the report of repeated keys itself: a raw table that
    breaks its key is refused. Intermediate tables are removed at the end. With ``fmt`` "json",
    amounts have no decimal type in the files.
    """
    return {name: table.folder for name, table in _run(spark, csv, out, encoding, fmt).items()}


def publish(spark: SparkSession, csv: str, root: str, encoding: str = "UTF-8", fmt: str = "parquet") -> versions.Version:
    """``run`` as one new version of all tables at ``root``: readers of ``versions`` see the old ones until all are there."""
    return versions.publish(spark, root, lambda folder: _run(spark, csv, folder, encoding, fmt))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("csv")
    parser.add_argument("out")
    parser.add_argument("--encoding", default="UTF-8")
    parser.add_argument("--format", default="parquet", choices=["parquet", "json"])
    parser.add_argument("--keep", default=versions.KEEP, type=int, help="versions to keep")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("shelfscan").getOrCreate()
    publish(spark, args.csv, args.out, args.encoding, args.format)
    versions.vacuum(spark, args.out, args.keep)
    spark.stop()


if __name__ == "__main__":
    main()
