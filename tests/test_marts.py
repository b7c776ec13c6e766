from __future__ import annotations

from pathlib import Path

import pytest

from shelfscan.operators import cleaning, marts, quality
from shelfscan.operators.cube import stock_cube
from shelfscan.plans import job, reports
from shelfscan.sources import listings, workspace


def _cube(df):
    return stock_cube(cleaning.clean_for_dashboard(df))


def test_empty_buckets_and_tiers_show_zero(raw):
    cube = _cube(raw({"discount_percent": 5}, {"discount_percent": 79}, {"discount_percent": 85}))
    assert [(r["label"], r["n"]) for r in marts.discount_distribution(cube).collect()] == [
        ("0-9%", 1), ("10-19%", 0), ("20-29%", 0), ("30-39%", 0),
        ("40-49%", 0), ("50-59%", 0), ("60-69%", 0), ("70-79%", 1),
    ]
    tiers = {r["label"]: (r["total"], r["oos"], r["rate"]) for r in marts.discount_vs_stockouts(cube).collect()}
    assert tiers["0%"] == (0, 0, 0.0)
    assert tiers[">40%"] == (2, 0, 0.0)


def test_cards_agree_with_the_filter(raw):
    df = raw({"category": "a"}, {"category": "b", "out_of_stock": "True", "available_quantity": 4})
    cards = {r["category"]: r for r in marts.kpis_by_category(_cube(df)).collect()}
    assert cards["a"]["inventory_value"] == 50.0 and cards["a"]["oos_rate"] == 0.0
    # out of stock: revenue counts what is listed, inventory value does not
    assert cards["b"]["revenue"] == 36.0 and cards["b"]["inventory_value"] == 0.0 and cards["b"]["oos_rate"] == 100.0
    total = marts.kpis(_cube(df)).first()
    assert (total["total_skus"], total["revenue"], total["oos_rate"]) == (2, 81.0, 50.0)


def test_cards_of_nothing(raw):
    total = marts.kpis(_cube(raw({"mrp": 0}))).first()
    assert (total["total_skus"], total["oos_count"], total["oos_rate"]) == (0, 0, 0.0)


def test_marts_are_written_and_replaced(spark, raw, tmp_path):
    df = cleaning.clean_for_dashboard(raw({"category": "a"}, {"category": "b"}))
    for _ in range(2):
        paths = marts.write_marts(df, str(tmp_path / "marts"), "json")
    assert spark.read.json(paths["scatter"]).where("category = 'a'").count() == 1
    assert spark.read.json(paths["categories"]).count() == 2


@pytest.mark.parametrize("bad", [[{"sku_id": "a"}, {"sku_id": "a"}], [{"category": None}]])
def test_broken_keys_are_refused(spark, raw, tmp_path, bad):
    source = listings.write_csv(raw(*bad), str(tmp_path / "csv"))
    with pytest.raises(ValueError, match="sku_id|category"):
        job.run(spark, source, str(tmp_path / "out"))


def test_one_scan_for_the_plain_audits(spark, raw, tmp_path):
    path = str(tmp_path / "scanned")
    listings.save_table(raw({}, {"mrp": 0}), path)
    df = spark.read.parquet(path)
    audits = {n: op for n, op in reports.AUDIT.items() if isinstance(op, quality.Summary)}
    assert {"c01_row_count", "c03_schema_overview", "c05_null_audit", "c13_rows_to_delete", "c15_scale_in_paise"} == audits.keys()
    together = quality.summarise_together(df, audits)
    for name, report in together.items():
        assert path not in "".join(report.inputFiles()), name  # the row of figures, not the table
        assert report.collect() == audits[name](df).collect(), name


def test_the_job_stores_the_dashboard_rows_once(spark, raw, tmp_path):
    source = listings.write_csv(raw({}, {"category": "B"}), str(tmp_path / "csv"))
    out = tmp_path / "out"
    paths = job.run(spark, source, str(out))
    assert paths["dashboard_all_rows"] == str(out / "dashboard_listings")
    assert not (out / "dashboard" / "all_rows").exists()
    scratch = [p for folder in workspace._own_folders(spark) for p in Path(folder).glob("scratch-*")]
    assert scratch == []
    assert spark.read.parquet(paths["c10_duplicate_keys"]).count() == 0


def test_a_failed_job_leaves_no_scratch(spark, raw, tmp_path):
    source = listings.write_csv(raw({"sku_id": "a"}, {"sku_id": "a"}), str(tmp_path / "csv"))
    with pytest.raises(ValueError, match="sku_id"):
        job.run(spark, source, str(tmp_path / "out"))
    assert not [p for folder in workspace._own_folders(spark) for p in Path(folder).glob("scratch-*")]


def test_listings_outside_the_ranges_are_counted(raw):
    cube = _cube(raw(*[{"discount_percent": d} for d in (5, 79, 80, 85, 100, 101, 105)]))
    got = {r["mart"]: (r["listings_outside"], r["highest_discount"]) for r in marts.outside_ranges(cube).collect()}
    assert got == {"discount_distribution": (5, 105), "discount_vs_oos": (2, 105)}


def test_whole_job(spark, raw, tmp_path):
    source = listings.write_csv(
        raw({"weight_in_gms": None}, {"category": "B", "out_of_stock": "True", "available_quantity": 0}, {"mrp": 0}),
        str(tmp_path / "csv"),
    )
    for _ in range(2):
        paths = job.run(spark, source, str(tmp_path / "out"))
    assert spark.read.parquet(paths["clean"]).count() == 2
    assert spark.read.parquet(paths["f5_overall_stockout_rate"]).first()[0] == 50.0
    assert spark.read.parquet(paths["dashboard_kpis"]).first()["total_skus"] == 2
