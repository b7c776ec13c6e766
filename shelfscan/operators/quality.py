"""Audits of raw and clean listings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscan import schema
from shelfscan.functions.exact import mean, money
from shelfscan.sources.workspace import materialize

Written = TypeVar("Written")

# Output names of the two null audits.
RAW_NULL_COUNTS = {
    "sku_id": "null_sku_id",
    "category": "null_category",
    "name": "null_name",
    "mrp": "null_mrp",
    "discount_percent": "null_discount_pct",
    "discounted_selling_price": "null_selling_price",
    "weight_in_gms": "null_weight",
    "available_quantity": "null_avail_qty",
    "out_of_stock": "null_oos",
}
CLEAN_NULL_COUNTS = {
    "mrp": "null_mrp",
    "discount_percent": "null_discount",
    "weight_in_gms": "null_weight",
    "out_of_stock": "null_oos",
}


@dataclass(frozen=True)
class Summary:
    """A report made of plain aggregates over all listings: several share one scan.

    ``figures`` gives the named aggregates (columns need a session, so they are made when asked
    for); ``shape`` makes the report of the one row that holds them.
    """

    figures: Callable[[], dict[str, Column]]
    shape: Callable[[DataFrame], DataFrame] = lambda row: row

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.shape(df.agg(*[figure.alias(name) for name, figure in self.figures().items()]))


def _named_figures(summaries: dict[str, Summary]) -> list[Column]:
    return [column.alias(f"{report}_{name}") for report, s in summaries.items() for name, column in s.figures().items()]


def _shaped(row: DataFrame, summaries: dict[str, Summary]) -> dict[str, DataFrame]:
    """The reports of the one row that has all their figures."""
    return {
        report: summary.shape(row.select(*[F.col(f"{report}_{name}").alias(name) for name in summary.figures()]))
        for report, summary in summaries.items()
    }


def summarise_together(df: DataFrame, summaries: dict[str, Summary]) -> dict[str, DataFrame]:
    """Several summaries of ``df`` from one scan; the row of all their figures is stored."""
    return _shaped(materialize(df.agg(*_named_figures(summaries)), "figures"), summaries)


def summarise_while(
    df: DataFrame, summaries: dict[str, Summary], write: Callable[[DataFrame], Written]
) -> tuple[Written, dict[str, DataFrame]]:
    """What ``write`` returns, and several summaries of ``df``, gathered while it is written.

    The table is not read again for them. ``write`` has to run one write of the frame that it is
    given. The figures are taken in the tasks that write, where a task that is repeated counts
    once.
    """
    spark, columns = df.sparkSession, _named_figures(summaries)
    observation = Observation()
    written = write(df.observe(observation, *columns))
    found = observation.get
    layout = df.agg(*columns).schema
    row = spark.createDataFrame([tuple(found[name] for name in layout.names)], layout).coalesce(1)
    return written, _shaped(row, summaries)


def row_count(name: str = "total_records") -> Summary:
    return Summary(lambda: {name: F.count("*")})


def _sql_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return "character varying"
    if isinstance(data_type, T.DecimalType):
        return "numeric"
    return {"int": "integer"}.get(data_type.simpleString(), data_type.simpleString())


def column_catalogue(declared: T.StructType = schema.RAW) -> Summary:
    """One row per column: position, name, type, declared nullability, NULLs found, smallest value.

    All columns are measured in one pass; nullability comes from the declared table, since a
    file reader makes every column nullable.
    """

    def figures() -> dict[str, Column]:
        nulls = {f"nulls_{f.name}": F.count_if(F.col(f.name).isNull()) for f in declared}
        return nulls | {f"sample_{f.name}": F.min(f.name).cast("string") for f in declared}

    def shape(row: DataFrame) -> DataFrame:
        rows = [
            F.struct(
                F.lit(position).alias("ordinal_position"),
                F.lit(field.name).alias("column_name"),
                F.lit(_sql_type(field.dataType)).alias("data_type"),
                F.lit("YES" if field.nullable else "NO").alias("is_nullable"),
                F.col(f"nulls_{field.name}").alias("null_count"),
                F.col(f"sample_{field.name}").alias("sample_value"),
            )
            for position, field in enumerate(declared, 1)
        ]
        return row.select(F.inline(F.array(*rows))).orderBy("ordinal_position")

    return Summary(figures, shape)


def _null_counts(names: dict[str, str]) -> dict[str, Column]:
    return {name: F.count_if(F.col(c).isNull()) for c, name in names.items()}


def null_audit() -> Summary:
    """Rows and NULLs per raw column."""
    return Summary(lambda: {"total_rows": F.count("*"), **_null_counts(RAW_NULL_COUNTS)})


def remaining_nulls() -> Summary:
    return Summary(lambda: _null_counts(CLEAN_NULL_COUNTS))


def unpriced_count(name: str = "rows_to_delete") -> Summary:
    return Summary(lambda: {name: F.count_if(F.col("mrp") == 0)})


def negative_discount_count(name: str = "negative_discount_remaining") -> Summary:
    return Summary(lambda: {name: F.count_if(F.col("discount_percent") < 0)})


def scale_in_paise() -> Summary:
    """Range and mean of the list prices that cleaning keeps."""

    def figures() -> dict[str, Column]:
        mrp = F.nullif(F.col("mrp"), F.lit(0))
        return {"min_mrp_paise": F.min(mrp), "max_mrp_paise": F.max(mrp), "avg_mrp_paise": mean(mrp, 0).cast("int")}

    return Summary(figures)


def scale_in_rupees() -> Summary:
    return Summary(
        lambda: {
            "min_mrp_rupees": money(F.min("mrp")),
            "max_mrp_rupees": money(F.max("mrp")),
            "avg_mrp_rupees": mean(F.col("mrp"), 2),
        }
    )


def require_valid_keys(nulls: DataFrame, duplicates: DataFrame, declared: T.StructType = schema.RAW) -> None:
    """Raise unless the columns that must be filled are, and every key occurs once.

    Decided from two reports that are made anyway: the null audit and the duplicate keys.
    """
    found = nulls.first().asDict()
    missing = [f.name for f in declared if not f.nullable and found[RAW_NULL_COUNTS[f.name]]]
    if missing:
        raise ValueError(f"NULL in columns that must be filled: {', '.join(missing)}")
    if not duplicates.isEmpty():
        raise ValueError("some sku_id occur more than once")


def category_counts(raw: DataFrame) -> DataFrame:
    """Per category what ``skus_by_category`` and ``cleaning_report`` count; both read it in place of the listings."""
    if "no_discount" in raw.columns:
        return raw
    zero = F.coalesce(F.col("mrp") == 0, F.lit(False))
    return raw.groupBy("category").agg(
        F.count("*").alias("listings"),
        F.count_if(F.col("discount_percent").isNull()).alias("no_discount"),
        F.count_if(F.col("weight_in_gms").isNull()).alias("no_weight"),
        F.count("weight_in_gms").alias("weights"),
        F.count_if(zero).alias("unpriced"),
        F.count_if((F.col("discount_percent") < 0) & ~zero).alias("negative"),
    )


def skus_by_category(df: DataFrame) -> DataFrame:
    counts = df if "listings" in df.columns else df.groupBy("category").agg(F.count("*").alias("listings"))
    return counts.select("category", F.col("listings").alias("sku_count")).orderBy(F.desc("sku_count"), "category")


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` listings by key, so that repeated looks show the same rows."""
    return df.orderBy("sku_id").limit(n)


def unpriced(df: DataFrame) -> DataFrame:
    return df.where("mrp = 0").select("sku_id", "category", "name", "mrp", "discounted_selling_price")


def negative_discounts(df: DataFrame) -> DataFrame:
    return df.where("discount_percent < 0").select(
        "sku_id", "category", "name", "mrp", "discount_percent", "discounted_selling_price"
    )


def flag_values(df: DataFrame) -> DataFrame:
    return df.groupBy("out_of_stock").agg(F.count("*").alias("cnt"))


def priced_above_list(df: DataFrame) -> DataFrame:
    return df.where("discounted_selling_price > mrp AND mrp > 0").select(
        "sku_id", "name", "mrp", "discount_percent", "discounted_selling_price"
    )


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Keys that occur more than once; the only enforcement of the primary key."""
    return df.groupBy("sku_id").agg(F.count("*").alias("cnt")).where("cnt > 1")


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Rows each cleaning step touches, from one pass over the raw listings.

    Counts are taken per category first: a missing weight can only be filled where the
    category has a known one.
    """
    per_category = category_counts(raw)
    fillable = F.when(F.col("category").isNotNull() & (F.col("weights") > 0), F.col("no_weight")).otherwise(0)
    kept = F.col("listings") - F.col("unpriced")
    totals = per_category.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(name)
            for name, c in {
                "no_discount": F.col("no_discount"),
                "filled": fillable,
                "unpriced": F.col("unpriced"),
                "negative": F.col("negative"),
                "kept": kept,
            }.items()
        ]
    )
    steps = [
        ("4a", "discount missing", "set to 0", "no_discount"),
        ("4b", "weight missing", "category median", "filled"),
        ("5a", "list price is 0", "row removed", "unpriced"),
        ("5b", "discount negative", "set to 0, sold at list price", "negative"),
        ("6", "prices in paise", "divided by 100", "kept"),
        ("7", "stock flag is text", "made boolean", "kept"),
        ("8", "no price per gram", "column added", "kept"),
        ("9", "no estimated revenue", "column added", "kept"),
    ]
    rows = [
        F.struct(
            F.lit(step).alias("step"),
            F.lit(issue).alias("issue"),
            F.lit(action).alias("action"),
            F.col(counter).alias("rows_affected"),
        )
        for step, issue, action, counter in steps
    ]
    return totals.select(F.inline(F.array(*rows)))
