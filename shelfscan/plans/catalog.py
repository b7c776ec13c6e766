"""All named queries: name -> function of (session, data folder)."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscan.operators import cleaning, cube, marts, measures, quality
from shelfscan.plans import reports, tables
from shelfscan.plans.reports import Operator
from shelfscan.sources import clustered, listings, sinks, versions
from shelfscan.sources.workspace import fresh_path, materialize

Query = Callable[[SparkSession, str], DataFrame]


def _doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison with other engines."""
    decimals = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else df


def _over(table: Query, operator: Operator) -> Query:
    return lambda spark, sf_dir: _doubles(operator(table(spark, sf_dir)))


def _each(table: Query, operators: dict[str, Operator]) -> dict[str, Query]:
    return {name: _over(table, operator) for name, operator in operators.items()}


def _columns(*names: str) -> Operator:
    return lambda df: df.select("sku_id", *names)


def _then(*steps: Operator) -> Operator:
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return run


# --- sources and sinks: write the raw listings out and read them back ---------------------


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = listings.write_csv(tables.raw(spark, sf_dir), fresh_path(spark, "csv"))
    return listings.read_strict(spark, path)


def _table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table, replaced by itself: the second version is computed from the first."""
    root = fresh_path(spark, "table")
    versions.replace(tables.raw(spark, sf_dir), root)
    versions.replace(versions.read(spark, root), root)
    return versions.read(spark, root)


class _CutOff(Exception):
    pass


def _table_after_failed_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that readers see after a replacement has failed when all its data was written."""
    root = fresh_path(spark, "table")
    versions.replace(tables.raw(spark, sf_dir), root)

    def cut_off(folder: str) -> dict:
        versions.table(lambda: tables.clean(spark, sf_dir))(f"{folder}/table")
        raise _CutOff

    with contextlib.suppress(_CutOff):
        versions.publish(spark, root, cut_off)
    return versions.read(spark, root)


def _earlier_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings as they were before unpriced ones went, from the version before."""
    root = fresh_path(spark, "table")
    raw = tables.raw(spark, sf_dir)
    first = versions.replace(raw, root)
    versions.replace(cleaning.drop_unpriced(versions.read(spark, root)), root, follows=first.number)
    now = versions.read(spark, root).select("sku_id", F.lit(True).alias("kept"))
    before = versions.read(spark, root, number=first.number)
    return before.join(now, "sku_id", "left").select("sku_id", "mrp", F.coalesce("kept", F.lit(False)).alias("kept"))


def _code_page_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    accented = tables.raw(spark, sf_dir).withColumn("name", F.concat(F.lit("Café ’"), "name", F.lit("’ – 5 €")))
    path = listings.write_csv(accented, fresh_path(spark, "code_page"), "windows-1252")
    return listings.read_strict(spark, path, "windows-1252")


def _messy_lines(spark: SparkSession, sf_dir: str) -> str:
    """Every listing as a line of text with quoted commas and doubled quotes in its name and
    nothing for a quantity of 0; unpriced listings add a blank line and a short one."""
    raw = tables.raw(spark, sf_dir)
    values = {f.name: F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in raw.schema}
    values["name"] = F.concat(F.lit('"'), F.col("name"), F.lit(', ""large"""'))
    values["available_quantity"] = F.when(F.col("available_quantity") == 0, "").otherwise(values["available_quantity"])
    line = F.concat_ws(",", *values.values())
    cut_off = F.concat("sku_id", F.lit(",cut off"))
    lines = F.when(F.col("mrp") == 0, F.array(line, F.lit(""), cut_off)).otherwise(F.array(line))
    path = fresh_path(spark, "messy")
    raw.select(F.explode(lines).alias("value")).write.text(path)
    return path


def _lenient_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.read_lenient(spark, _messy_lines(spark, sf_dir), header=False)


def _accepted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = listings.read_with_quarantine(spark, _messy_lines(spark, sf_dir), header=False)
    return good


def _quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = listings.read_with_quarantine(spark, _messy_lines(spark, sf_dir), header=False)
    return bad


def _sizes(marts_read: dict[str, DataFrame]) -> DataFrame:
    """Rows in each table."""
    sizes = [df.agg(F.lit(name).alias("mart"), F.count("*").alias("row_count")) for name, df in marts_read.items()]
    return functools.reduce(DataFrame.unionByName, sizes)


def _mart_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dashboard tables published and read back."""
    root = fresh_path(spark, "marts")
    marts.publish_marts(tables.dashboard(spark, sf_dir), root)
    return _sizes(versions.read_all(spark, root))


def _mart_sizes_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dashboard tables after a second set was written but for one table that failed."""
    root = fresh_path(spark, "marts")
    dashboard = tables.dashboard(spark, sf_dir)
    marts.publish_marts(dashboard, root)

    def fails() -> DataFrame:
        raise _CutOff

    writers = marts.mart_writers(dashboard.where("available_quantity > 0"))
    with contextlib.suppress(_CutOff):
        versions.publish_tables(spark, root, {**writers, "kpis": versions.table(fails)})
    return _sizes(versions.read_all(spark, root))


def _odd_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scatter with categories that folder names lose: the empty text, NULL, digits, the mark itself; per category."""
    points = marts.scatter(tables.dashboard(spark, sf_dir))
    odd = F.array(F.lit(""), F.lit(None).cast("string"), F.lit("007"), F.lit("7"), F.lit(sinks.EMPTY_MARK), F.lit("a/b=c %"))
    points = points.withColumn("category", F.get(odd, (F.col("discount_percent") % 6).cast("int")))
    root = fresh_path(spark, "odd")
    versions.publish_tables(spark, root, {"scatter": versions.table(lambda: points, partition="category")})
    return versions.read(spark, root, "scatter").groupBy("category").agg(F.count("*").alias("points"), F.max("mrp").cast("double").alias("mrp"))


def _json_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of amounts published as JSON: their types come from the manifest."""
    root = fresh_path(spark, "json")
    mart = marts.revenue_by_category(tables.dashboard(spark, sf_dir))
    versions.replace(mart, root, "json")
    found = versions.read(spark, root)
    assert found.dtypes == mart.dtypes
    return _doubles(found)


def _json_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = marts.revenue_by_category(tables.dashboard(spark, sf_dir))
    path = sinks.write_table(mart, fresh_path(spark, "json"), "json")
    return spark.read.schema("category string, revenue double").json(path)


def _partitioned_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = marts.scatter(tables.dashboard(spark, sf_dir))
    path = sinks.write_partitioned(points, fresh_path(spark, "scatter"), "category")
    return _doubles(sinks.read_partitioned(spark, path, points.schema, "category"))


def _observed(table: Query, summaries: list[quality.Summary]) -> Query:
    """The figures of several reports in one row, gathered while the table is written."""
    together = quality.Summary(lambda: {name: figure for s in summaries for name, figure in s.figures().items()})

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fresh_path(spark, "observed")
        _, found = quality.summarise_while(table(spark, sf_dir), {"all": together}, lambda seen: sinks.write_table(seen, path))
        return _doubles(found["all"])

    return query


def _sketched_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names by stock flag and category: exact, and whether the cube's estimate is within 5 % or one of it."""
    by = ["category", "out_of_stock"]
    clean = tables.clean(spark, sf_dir)
    sketched = materialize(cube.stock_cube(clean, sketch_names=True), "cube")
    estimated = cube.distinct_names(cube.stock_cube(sketched), by).withColumnRenamed("unique_products", "estimate")
    off = F.abs(F.col("estimate") - F.col("unique_products"))
    near = (off <= F.greatest(F.lit(1), F.col("unique_products") * 0.05)).alias("estimate_near")
    same = F.col("c.category").eqNullSafe(F.col("e.category")) & (F.col("c.out_of_stock") == F.col("e.out_of_stock"))
    exact = cube.distinct_names(clean, by).alias("c")
    return exact.join(estimated.alias("e"), same).select(*[f"c.{name}" for name in by], "unique_products", near)


def _top_products_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of the first category, from a table laid out so that it reads few files."""
    dashboard = tables.dashboard(spark, sf_dir)
    path = clustered.write(dashboard, fresh_path(spark, "clustered"), "category", "estimated_revenue")
    first = dashboard.agg(F.min("category")).first()[0]
    return _doubles(marts.top_products(clustered.candidates(spark, path, "category", 10, first)))


def _mart(build: Operator) -> Query:
    return _over(tables.dashboard, build)


RAW_PRICES = ("mrp", "discounted_selling_price")

CATALOG: dict[str, Query] = {
    # sources and sinks
    "s01_csv_load": _csv_round_trip,
    "s02_table_replace": _table_round_trip,
    "s02_failed_replacement": _table_after_failed_replacement,
    "s02_earlier_version": _earlier_version,
    "s03_code_page_load": _code_page_round_trip,
    "s04_lenient_load": _lenient_load,
    "s04_accepted_lines": _accepted_lines,
    "s04_quarantined_lines": _quarantined_lines,
    "s05_typed_with_defaults": lambda spark, sf_dir: cleaning.flag_to_boolean(_lenient_load(spark, sf_dir)),
    "s06_marts_written": _mart_sizes,
    "s06_failed_marts": _mart_sizes_after_failure,
    "s06_json_version": _json_version,
    "s06_odd_folder_names": _odd_folder_names,
    "s06_json_mart": _json_mart,
    "s06_partitioned_mart": _partitioned_mart,
    "s07_column_catalogue": _over(tables.raw, quality.column_catalogue()),
    "s08_preview": _over(tables.raw, quality.preview),
    # audit, cleaning steps and analysis
    **_each(tables.raw, reports.AUDIT),
    **_each(tables.clean, reports.VALIDATION),
    "c01_c15_observed_audit": _observed(
        tables.raw,
        [quality.unpriced_count(), quality.scale_in_paise(), quality.row_count()],
    ),
    "c17_c24_observed_validation": _observed(
        lambda spark, sf_dir: cleaning.clean(tables.raw(spark, sf_dir)),
        [r for r in reports.VALIDATION.values() if isinstance(r, quality.Summary)],
    ),
    "c11_filled_discounts": _over(tables.raw, _then(cleaning.fill_discounts, _columns("discount_percent"))),
    "c12_filled_weights": _over(tables.raw, _then(cleaning.fill_weights, _columns("weight_in_gms"))),
    "c12_category_weights": _over(tables.raw, cleaning.category_weights),
    "c13_priced": _over(tables.raw, _then(cleaning.drop_unpriced, _columns(*RAW_PRICES))),
    "c14_fixed_discounts": _over(
        tables.raw, _then(cleaning.fix_negative_discounts, _columns("discount_percent", *RAW_PRICES))
    ),
    "c16_rupees": _over(tables.raw, _then(cleaning.to_major_units, _columns(*RAW_PRICES))),
    "c18_boolean_flag": _over(tables.raw, _then(cleaning.flag_to_boolean, _columns("out_of_stock"))),
    "c19_price_per_gram": _over(tables.clean, _columns("price_per_gram")),
    "c20_estimated_revenue": _over(tables.clean, _columns("estimated_revenue")),
    "c20_clean_table": _over(tables.clean, lambda df: df),
    **_each(tables.clean, reports.EXPLORATION),
    **_each(tables.clean, reports.BUSINESS),
    "b21_sketched_products": _sketched_products,
    **_each(tables.clean, reports.FINDINGS),
    # dashboard cleaning
    "j1_priced": _over(
        tables.raw, _then(lambda df: cleaning.drop_unpriced(df, drop_null=True), _columns(*RAW_PRICES))
    ),
    "j2_fixed_discounts": _over(
        tables.raw, _then(cleaning.repair_discounts_for_dashboard, _columns("discount_percent", *RAW_PRICES))
    ),
    "j3_filled_weights": _over(tables.raw, _then(cleaning.repair_for_dashboard, _columns("weight_in_gms"))),
    "j4_rupees": _over(tables.dashboard, _columns(*RAW_PRICES)),
    "j5_derived_columns": _over(tables.dashboard, _columns("price_per_gram", "estimated_revenue")),
    # dashboard tables
    "d01_kpis": _mart(marts.kpis),
    "d02_categories": _mart(marts.categories),
    "d03_revenue_by_category": _mart(marts.revenue_by_category),
    "d04_oos_by_category": _mart(marts.stockouts_by_category),
    "d04_oos_top_categories": _mart(marts.worst_stockouts),
    "d05_discount_distribution": _mart(marts.discount_distribution),
    "d06_discount_vs_oos": _mart(marts.discount_vs_stockouts),
    "d05_d06_outside_ranges": _mart(marts.outside_ranges),
    "d07_avg_discount_by_category": _mart(marts.discount_by_category),
    "d08_stock_by_category": _mart(marts.stock_by_category),
    "d09_top_products": _over(tables.dashboard, marts.top_products),
    "d10_scatter": _over(tables.dashboard, marts.scatter),
    "d11_all_rows": _over(tables.dashboard, lambda df: df),
    "d12_kpis_by_category": _mart(marts.kpis_by_category),
    "d13_top_products_by_category": _over(tables.dashboard, marts.top_products_by_category),
    "d13_top_products_of_one_category": _top_products_of_one,
    # BI measures
    "m1_total_skus": _over(tables.light, measures.total_skus),
    "m2_revenue": _over(tables.light, measures.revenue),
    "m3_stockout_rate": _over(tables.light, measures.stockout_rate),
    "m4_row_level_revenue": _over(tables.raw, measures.row_level_revenue),
    "m5_by_category": _over(tables.raw, _then(cleaning.typed, measures.by_category)),
    "m6_discount_bins": _over(tables.raw, _then(cleaning.typed, measures.discount_bins)),
    "m7_light_clean": _over(tables.light, lambda df: df),
}
