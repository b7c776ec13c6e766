"""The queries of the catalog as DuckDB SQL over the driver tables.

Money is kept in whole paise and price per gram in ten-thousandths, so that every rounded
figure comes from one integer division (see ``_r``). Lists that end in a limit put NULLs first
in descending order, as the reports define it.
"""

from __future__ import annotations


def _r(num: str, den: str, digits: int) -> str:
    """``num / den`` for integers, rounded half away from zero to ``digits`` places, as DOUBLE.

    The quotient without its sign, plus one if twice the remainder reaches the divisor.
    """
    unit = 10**digits
    n, d = f"(ABS(CAST({num} AS HUGEINT)) * {unit})", f"NULLIF(ABS(CAST({den} AS HUGEINT)), 0)"
    whole = f"({n} // {d} + CASE WHEN 2 * ({n} % {d}) >= {d} THEN 1 ELSE 0 END)"
    sign = f"CASE WHEN (({num}) < 0) <> (({den}) < 0) THEN -1 ELSE 1 END"
    return f"CAST({sign} * {whole} AS DOUBLE) / CAST({unit} AS DOUBLE)"


def _avg(col: str, digits: int, unit: int = 1) -> str:
    return _r(f"SUM({col})", f"COUNT({col}) * {unit}", digits)


def _pct(part: str, whole: str) -> str:
    return _r(f"({part}) * 100", whole, 1)


def _money(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE) / CAST(100 AS DOUBLE)"


RAW = """
offers AS (
    SELECT l_partkey AS p, l_suppkey AS s, MIN(l_extendedprice) AS ext, CAST(SUM(l_quantity) AS BIGINT) AS q
    FROM lineitem GROUP BY l_partkey, l_suppkey
),
shaped AS (
    SELECT p, s, q, p_type, p_name, p_size,
        1000 + CAST(ROUND(ext * 100) AS BIGINT) % 199001 AS m,
        CASE WHEN (31*p + 37*s) % 100 < 15 THEN 35 + (13*p + 7*s) % 36
             WHEN (31*p + 37*s) % 100 < 20 THEN 0
             ELSE 1 + (13*p + 7*s) % 35 END AS d,
        (7*p + 3*s) % 100 = 9 AS zero,
        (3*p + 11*s) % 200 = 7 AS neg
    FROM offers JOIN part ON p_partkey = p
),
flagged AS (
    SELECT *, (17*p + 29*s) % 100 < 12 + CAST(d AS DOUBLE) / 2 + CASE WHEN p_type = 'PROMO' THEN 35 ELSE 0 END AS oos
    FROM shaped
),
raw AS (
    SELECT 'SKU' || lpad(CAST(p AS VARCHAR), 7, '0') || '-' || lpad(CAST(s AS VARCHAR), 5, '0') AS sku_id,
        p_type AS category,
        p_name AS name,
        CAST(CASE WHEN zero THEN 0 ELSE m END AS INTEGER) AS mrp,
        CAST(CASE WHEN neg THEN -(1 + p % 10) WHEN (5*p + s) % 20 = 0 THEN NULL ELSE d END AS INTEGER) AS discount_percent,
        CAST(CASE WHEN zero THEN 0 WHEN neg THEN m + 100 ELSE (m * (100 - d)) // 100 END AS INTEGER)
            AS discounted_selling_price,
        CAST(CASE WHEN (p + 7*s) % 20 = 3 THEN NULL ELSE p_size * 60 END AS INTEGER) AS weight_in_gms,
        CAST(CASE WHEN oos THEN 0 ELSE 1 + q % 200 END AS INTEGER) AS available_quantity,
        CASE WHEN oos THEN 'True' ELSE 'False' END AS out_of_stock
    FROM flagged
)"""

# price per gram in ten-thousandths, from the remainder of the price without its sign
PER_GRAM = (
    "CAST(SIGN(sp) AS BIGINT) * (ABS(CAST(sp AS BIGINT)) * 100 // weight_in_gms"
    " + CASE WHEN 2 * (ABS(CAST(sp AS BIGINT)) * 100 % weight_in_gms) >= weight_in_gms THEN 1 ELSE 0 END)"
)

CLEAN = f"""
weights AS (
    SELECT category,
        CAST(round_even(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY CAST(weight_in_gms AS DOUBLE)), 0) AS INTEGER) AS w
    FROM raw WHERE weight_in_gms IS NOT NULL GROUP BY category
),
filled AS (
    SELECT sku_id, raw.category, name, mrp,
        CASE WHEN discount_percent < 0 THEN 0 ELSE COALESCE(discount_percent, 0) END AS discount_percent,
        CASE WHEN discount_percent < 0 THEN mrp ELSE discounted_selling_price END AS sp,
        COALESCE(weight_in_gms, w) AS weight_in_gms,
        available_quantity AS qty,
        COALESCE(out_of_stock = 'True', FALSE) AS out_of_stock
    FROM raw LEFT JOIN weights ON raw.category = weights.category
    WHERE mrp IS NULL OR mrp <> 0
),
clean AS (
    SELECT *,
        CASE WHEN weight_in_gms > 0 THEN {PER_GRAM} END AS ppg,
        CAST(sp AS BIGINT) * qty AS rev,
        CAST(mrp AS BIGINT) * qty AS val
    FROM filled
)"""

DASHBOARD = f"""
priced AS (
    SELECT sku_id, category, name, mrp,
        CASE WHEN discount_percent < 0 THEN 0 ELSE COALESCE(discount_percent, 0) END AS discount_percent,
        CASE WHEN discount_percent < 0 THEN mrp ELSE COALESCE(discounted_selling_price, 0) END AS sp,
        weight_in_gms AS w,
        COALESCE(available_quantity, 0) AS qty,
        COALESCE(out_of_stock = 'True', FALSE) AS out_of_stock
    FROM raw WHERE mrp <> 0
),
placed AS (
    SELECT category, w, ROW_NUMBER() OVER (PARTITION BY category ORDER BY w) - 1 AS place,
        COUNT(*) OVER (PARTITION BY category) // 2 AS middle
    FROM priced WHERE w IS NOT NULL
),
weights AS (SELECT category, w AS median_weight FROM placed WHERE place = middle),
weighed AS (
    SELECT priced.* EXCLUDE (w), CAST(COALESCE(w, NULLIF(median_weight, 0), 500) AS INTEGER) AS weight_in_gms
    FROM priced LEFT JOIN weights ON priced.category = weights.category
),
dash AS (
    SELECT *,
        CASE WHEN weight_in_gms > 0 THEN {PER_GRAM} ELSE 0 END AS ppg,
        CAST(sp AS BIGINT) * qty AS rev,
        CAST(mrp AS BIGINT) * qty AS val
    FROM weighed
)"""

LIGHT = """
light AS (
    SELECT sku_id, category, name, mrp, COALESCE(discount_percent, 0) AS discount_percent,
        discounted_selling_price AS sp, weight_in_gms, available_quantity AS qty,
        COALESCE(out_of_stock = 'True', FALSE) AS out_of_stock
    FROM raw WHERE mrp IS NULL OR mrp <> 0
)"""


def _raw(select: str) -> str:
    return f"WITH {RAW}\n{select}"


def _clean(select: str) -> str:
    return f"WITH {RAW}, {CLEAN}\n{select}"


def _dash(select: str) -> str:
    return f"WITH {RAW}, {DASHBOARD}\n{select}"


def _light(select: str) -> str:
    return f"WITH {RAW}, {LIGHT}\n{select}"


MRP = f"{_money('mrp')} AS mrp"
SP = f"{_money('sp')} AS discounted_selling_price"
PPG = "CAST(ppg AS DOUBLE) / CAST(10000 AS DOUBLE)"
OOS = "COUNT(*) FILTER (WHERE out_of_stock)"
RATE = _pct(OOS, "COUNT(*)")

CLEAN_ROW = f"""sku_id, category, name, {MRP}, discount_percent, {SP}, weight_in_gms,
    qty AS available_quantity, out_of_stock, {PPG} AS price_per_gram, {_money('rev')} AS estimated_revenue"""


def _position(col: str, bands: list[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN {col} {test} THEN {i}" for i, (_, test) in enumerate(bands, 1))
    return f"CAST(CASE {cases} END AS INTEGER)"


def _bands(col: str, bands: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {col} {test} THEN '{label}'" for label, test in bands) + " END"


TENS = [
    ("0% (No discount)", "= 0"),
    ("1-10%", "BETWEEN 1 AND 10"),
    ("11-20%", "BETWEEN 11 AND 20"),
    ("21-30%", "BETWEEN 21 AND 30"),
    ("31-40%", "BETWEEN 31 AND 40"),
]
BRACKETS = [
    *TENS,
    ("41-50%", "BETWEEN 41 AND 50"),
    ("51-60%", "BETWEEN 51 AND 60"),
    ("61-70%", "BETWEEN 61 AND 70"),
    ("70%+", "> 70"),
]
TIERS = [*TENS, (">40%", "> 40")]
WEIGHTS = [
    ("Ultra Light (<100g)", "< 100"),
    ("Light (100-250g)", "BETWEEN 100 AND 250"),
    ("Medium (251-500g)", "BETWEEN 251 AND 500"),
    ("Heavy (501-1000g)", "BETWEEN 501 AND 1000"),
    ("Bulk (>1kg)", "> 1000"),
]
NUMBERED_WEIGHTS = [(f"{i}. {label}", test) for i, (label, test) in enumerate(WEIGHTS, 1)]

# position, name, type and nullability of the raw columns
COLUMNS = [
    ("sku_id", "character varying", "NO"),
    ("category", "character varying", "NO"),
    ("name", "character varying", "NO"),
    ("mrp", "integer", "YES"),
    ("discount_percent", "integer", "YES"),
    ("discounted_selling_price", "integer", "YES"),
    ("weight_in_gms", "integer", "YES"),
    ("available_quantity", "integer", "YES"),
    ("out_of_stock", "character varying", "YES"),
]


def _catalogue() -> str:
    rows = [
        f"SELECT CAST({i} AS INTEGER) AS ordinal_position, '{name}' AS column_name, '{kind}' AS data_type,"
        f" '{nullable}' AS is_nullable, COUNT(*) FILTER (WHERE {name} IS NULL) AS null_count,"
        f" CAST(MIN({name}) AS VARCHAR) AS sample_value FROM raw"
        for i, (name, kind, nullable) in enumerate(COLUMNS, 1)
    ]
    return _raw("\nUNION ALL ".join(rows))


def _summary(label: str, col: str, unit: int) -> str:
    u = f"CAST({unit} AS DOUBLE)"
    return f"""SELECT '{label}' AS metric, COUNT({col}) AS count, CAST(MIN({col}) AS DOUBLE) / {u} AS min_val,
        CAST(MAX({col}) AS DOUBLE) / {u} AS max_val, {_avg(col, 2, unit)} AS mean_val,
        {_r(f"CAST(2 * PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY CAST({col} AS DOUBLE)) AS BIGINT)", str(2 * unit), 2)}
            AS median_val,
        ROUND(STDDEV_SAMP(CAST({col} AS DOUBLE) / {u}), 2) AS std_dev FROM clean"""


def _report() -> str:
    steps = [
        ("4a", "discount missing", "set to 0", "COUNT(*) FILTER (WHERE discount_percent IS NULL)"),
        (
            "4b",
            "weight missing",
            "category median",
            "COUNT(*) FILTER (WHERE weight_in_gms IS NULL AND category IN"
            " (SELECT category FROM raw WHERE weight_in_gms IS NOT NULL))",
        ),
        ("5a", "list price is 0", "row removed", "COUNT(*) FILTER (WHERE mrp = 0)"),
        (
            "5b",
            "discount negative",
            "set to 0, sold at list price",
            "COUNT(*) FILTER (WHERE discount_percent < 0 AND mrp IS DISTINCT FROM 0)",
        ),
        ("6", "prices in paise", "divided by 100", "COUNT(*) FILTER (WHERE mrp IS DISTINCT FROM 0)"),
        ("7", "stock flag is text", "made boolean", "COUNT(*) FILTER (WHERE mrp IS DISTINCT FROM 0)"),
        ("8", "no price per gram", "column added", "COUNT(*) FILTER (WHERE mrp IS DISTINCT FROM 0)"),
        ("9", "no estimated revenue", "column added", "COUNT(*) FILTER (WHERE mrp IS DISTINCT FROM 0)"),
    ]
    return _raw(
        "\nUNION ALL ".join(
            f"SELECT '{a}' AS step, '{b}' AS issue, '{c}' AS action, {n} AS rows_affected FROM raw"
            for a, b, c, n in steps
        )
    )


def _nulls(names: dict[str, str]) -> str:
    return ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS {name}" for c, name in names.items())


LOST = f"""benchmarks AS (
    SELECT category, {_avg('sp', 0)} AS price, {_avg('qty', 0)} AS quantity
    FROM clean WHERE NOT out_of_stock GROUP BY category
),
lost AS (
    SELECT z.category, COUNT(*) AS oos_sku_count, price / CAST(100 AS DOUBLE) AS avg_category_price,
        quantity AS avg_category_qty, COUNT(*) * CAST(price AS HUGEINT) * CAST(quantity AS HUGEINT) AS paise
    FROM clean z JOIN benchmarks b ON z.category = b.category
    WHERE z.out_of_stock GROUP BY z.category, price, quantity
)"""

RANKED = """ranked AS (
    SELECT name, category, rev, sku_id,
        SUM(rev) OVER (ORDER BY rev DESC) AS cumulative,
        SUM(rev) OVER () AS total,
        ROW_NUMBER() OVER (ORDER BY rev DESC, sku_id) AS place,
        COUNT(*) OVER () AS n
    FROM clean WHERE rev > 0
)"""
PARETO = f"""SELECT {_r('place * 100', 'n', 0)} AS product_percentile, name, category, {_money('rev')} AS revenue,
    {_pct('cumulative', 'total')} AS cumulative_revenue_pct
FROM ranked WHERE place <= (n + 4) // 5"""

PRODUCT = f"name, category, {_money('rev')} AS revenue, discount_percent AS discount, qty AS quantity"
CARDS = f"""COUNT(*) AS total_skus, {_money('SUM(rev)')} AS revenue,
    {_money('COALESCE(SUM(val) FILTER (WHERE NOT out_of_stock), 0)')} AS inventory_value, {OOS} AS oos_count,
    {RATE} AS oos_rate, {_avg('discount_percent', 1)} AS avg_discount"""
DASH_TIERS = [
    ("0%", 0, 0),
    ("1-10%", 1, 10),
    ("11-20%", 11, 20),
    ("21-30%", 21, 30),
    ("31-40%", 31, 40),
    (">40%", 41, 100),
]
DASH_OOS = f"SELECT category, {RATE} AS oos_rate FROM dash GROUP BY category"
SALE = "CASE WHEN NOT out_of_stock THEN CAST(sp AS BIGINT) * qty END"
FRACTION = f"CAST({OOS} AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)"

DISTRIBUTION = "\nUNION ALL ".join(
    f"SELECT CAST({e} AS INTEGER) AS bucket_start, '{e}-{e + 9}%' AS label,"
    f" COUNT(*) FILTER (WHERE discount_percent BETWEEN {e} AND {e + 9}) AS n FROM dash"
    for e in range(0, 71, 10)
)
TIER_RATES = "\nUNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS tier_index, '{label}' AS label, COUNT(*) AS total, {OOS} AS oos,"
    f" COALESCE({RATE}, 0) AS rate FROM dash WHERE discount_percent BETWEEN {low} AND {high}"
    for i, (label, low, high) in enumerate(DASH_TIERS, 1)
)
SIZES = "\nUNION ALL ".join(
    f"SELECT '{mart}' AS mart, CAST({size} AS BIGINT) AS row_count"
    for mart, size in {
        "kpis": "1",
        **{
            m: "(SELECT COUNT(*) FROM (SELECT DISTINCT category FROM dash))"
            for m in (
                "kpis_by_category",
                "categories",
                "revenue_by_category",
                "oos_by_category",
                "avg_discount_by_category",
                "stock_by_category",
            )
        },
        "oos_top_categories": "(SELECT LEAST(5, COUNT(*)) FROM (SELECT DISTINCT category FROM dash))",
        "discount_distribution": "8",
        "discount_vs_oos": "6",
        "outside_ranges": "2",
        "top_products": "(SELECT LEAST(10, COUNT(*)) FROM dash)",
        "top_products_by_category": "(SELECT SUM(LEAST(10, c)) FROM (SELECT COUNT(*) AS c FROM dash GROUP BY category))",
        "all_rows": "(SELECT COUNT(*) FROM dash)",
        "scatter": "(SELECT COUNT(*) FROM dash WHERE NOT out_of_stock AND mrp > 0)",
    }.items()
)

MESSY = _raw("SELECT * REPLACE (name || ', \"large\"' AS name) FROM raw")
MARKDOWN = "mrp - sp"
MARKDOWN_ROW = f"name, category, {MRP}, discount_percent, {SP}"

ORACLE: dict[str, str] = {
    "s01_csv_load": _raw("SELECT * FROM raw"),
    "s02_table_replace": _raw("SELECT * FROM raw"),
    "s02_failed_replacement": _raw("SELECT * FROM raw"),
    "s02_earlier_version": _raw("SELECT sku_id, mrp, mrp IS NULL OR mrp <> 0 AS kept FROM raw"),
    "s03_code_page_load": _raw("SELECT * REPLACE ('Café ’' || name || '’ – 5 €' AS name) FROM raw"),
    "s04_lenient_load": MESSY,
    "s04_accepted_lines": _raw(
        "SELECT * REPLACE (name || ', \"large\"' AS name, NULLIF(available_quantity, 0) AS available_quantity) FROM raw"
    ),
    "s04_quarantined_lines": _raw("SELECT sku_id || ',cut off' AS line FROM raw WHERE mrp = 0"),
    "s05_typed_with_defaults": _raw(
        "SELECT * REPLACE (name || ', \"large\"' AS name, out_of_stock = 'True' AS out_of_stock) FROM raw"
    ),
    "s06_marts_written": _dash(SIZES),
    "s06_failed_marts": _dash(SIZES),
    "s06_json_version": _dash(f"SELECT category, {_money('SUM(rev)')} AS revenue FROM dash GROUP BY category"),
    "s06_odd_folder_names": _dash(
        f"SELECT ['', NULL, '007', '7', '∅', 'a/b=c %'][discount_percent % 6 + 1] AS category, COUNT(*) AS points, MAX({MRP.rpartition(' AS ')[0]}) AS mrp"
        " FROM dash WHERE NOT out_of_stock AND mrp > 0 GROUP BY 1"
    ),
    "s06_json_mart": _dash(f"SELECT category, {_money('SUM(rev)')} AS revenue FROM dash GROUP BY category"),
    "s06_partitioned_mart": _dash(
        f"SELECT {MRP}, discount_percent, category, name FROM dash WHERE NOT out_of_stock AND mrp > 0"
    ),
    "s07_column_catalogue": _catalogue(),
    "s08_preview": _raw("SELECT * FROM raw ORDER BY sku_id LIMIT 20"),
    "c01_row_count": _raw("SELECT COUNT(*) AS total_records FROM raw"),
    "c02_skus_by_category": _raw("SELECT category, COUNT(*) AS sku_count FROM raw GROUP BY category"),
    "c03_schema_overview": _catalogue(),
    "c04_preview": _raw("SELECT * FROM raw ORDER BY sku_id LIMIT 20"),
    "c05_null_audit": _raw(
        "SELECT COUNT(*) AS total_rows, "
        + _nulls(
            {
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
        )
        + " FROM raw"
    ),
    "c06_unpriced": _raw("SELECT sku_id, category, name, mrp, discounted_selling_price FROM raw WHERE mrp = 0"),
    "c07_negative_discounts": _raw(
        "SELECT sku_id, category, name, mrp, discount_percent, discounted_selling_price FROM raw"
        " WHERE discount_percent < 0"
    ),
    "c08_flag_values": _raw("SELECT out_of_stock, COUNT(*) AS cnt FROM raw GROUP BY out_of_stock"),
    "c09_priced_above_list": _raw(
        "SELECT sku_id, name, mrp, discount_percent, discounted_selling_price FROM raw"
        " WHERE discounted_selling_price > mrp AND mrp > 0"
    ),
    "c10_duplicate_keys": _raw("SELECT sku_id, COUNT(*) AS cnt FROM raw GROUP BY sku_id HAVING COUNT(*) > 1"),
    "c11_filled_discounts": _raw("SELECT sku_id, COALESCE(discount_percent, 0) AS discount_percent FROM raw"),
    "c12_filled_weights": _clean(
        "SELECT sku_id, COALESCE(weight_in_gms, w) AS weight_in_gms FROM raw LEFT JOIN weights"
        " ON raw.category = weights.category"
    ),
    "c12_category_weights": _clean("SELECT category, w AS median_weight FROM weights"),
    "c13_rows_to_delete": _raw("SELECT COUNT(*) AS rows_to_delete FROM raw WHERE mrp = 0"),
    "c13_priced": _raw("SELECT sku_id, mrp, discounted_selling_price FROM raw WHERE mrp IS NULL OR mrp <> 0"),
    "c14_fixed_discounts": _raw(
        "SELECT sku_id, CASE WHEN discount_percent < 0 THEN 0 ELSE discount_percent END AS discount_percent, mrp,"
        " CASE WHEN discount_percent < 0 THEN mrp ELSE discounted_selling_price END AS discounted_selling_price FROM raw"
    ),
    "c15_scale_in_paise": _raw(
        f"SELECT MIN(mrp) AS min_mrp_paise, MAX(mrp) AS max_mrp_paise, CAST({_avg('mrp', 0)} AS INTEGER) AS avg_mrp_paise"
        " FROM raw WHERE mrp IS NULL OR mrp <> 0"
    ),
    "c16_rupees": _raw(
        f"SELECT sku_id, {MRP}, {_money('discounted_selling_price')} AS discounted_selling_price FROM raw"
    ),
    "c17_scale_in_rupees": _clean(
        f"SELECT {_money('MIN(mrp)')} AS min_mrp_rupees, {_money('MAX(mrp)')} AS max_mrp_rupees,"
        f" {_avg('mrp', 2, 100)} AS avg_mrp_rupees FROM clean"
    ),
    "c18_boolean_flag": _raw("SELECT sku_id, COALESCE(out_of_stock = 'True', FALSE) AS out_of_stock FROM raw"),
    "c19_price_per_gram": _clean(f"SELECT sku_id, {PPG} AS price_per_gram FROM clean"),
    "c20_estimated_revenue": _clean(f"SELECT sku_id, {_money('rev')} AS estimated_revenue FROM clean"),
    "c20_clean_table": _clean(f"SELECT {CLEAN_ROW} FROM clean"),
    "c21_remaining_nulls": _clean(
        "SELECT "
        + _nulls(
            {
                "mrp": "null_mrp",
                "discount_percent": "null_discount",
                "weight_in_gms": "null_weight",
                "out_of_stock": "null_oos",
            }
        )
        + " FROM clean"
    ),
    "c22_unpriced_remaining": _clean("SELECT COUNT(*) AS zero_mrp_remaining FROM clean WHERE mrp = 0"),
    "c23_negative_remaining": _clean(
        "SELECT COUNT(*) AS negative_discount_remaining FROM clean WHERE discount_percent < 0"
    ),
    "c01_c15_observed_audit": _raw(
        "SELECT COUNT(*) FILTER (WHERE mrp = 0) AS rows_to_delete, MIN(NULLIF(mrp, 0)) AS min_mrp_paise,"
        " MAX(NULLIF(mrp, 0)) AS max_mrp_paise, CAST(floor((2 * SUM(mrp) + COUNT(NULLIF(mrp, 0))) /"
        " (2 * COUNT(NULLIF(mrp, 0)))) AS INTEGER) AS avg_mrp_paise, COUNT(*) AS total_records FROM raw"
    ),
    "c17_c24_observed_validation": _clean(
        f"SELECT {_money('MIN(mrp)')} AS min_mrp_rupees, {_money('MAX(mrp)')} AS max_mrp_rupees,"
        f" {_avg('mrp', 2, 100)} AS avg_mrp_rupees, COUNT(*) FILTER (WHERE mrp IS NULL) AS null_mrp,"
        " COUNT(*) FILTER (WHERE discount_percent IS NULL) AS null_discount,"
        " COUNT(*) FILTER (WHERE weight_in_gms IS NULL) AS null_weight, COUNT(*) FILTER (WHERE out_of_stock IS NULL) AS null_oos,"
        " COUNT(*) FILTER (WHERE mrp = 0) AS zero_mrp_remaining,"
        " COUNT(*) FILTER (WHERE discount_percent < 0) AS negative_discount_remaining, COUNT(*) AS cleaned_total_records FROM clean"
    ),
    "c24_clean_row_count": _clean("SELECT COUNT(*) AS cleaned_total_records FROM clean"),
    "c25_clean_preview": _clean(f"SELECT {CLEAN_ROW} FROM clean ORDER BY sku_id LIMIT 10"),
    "c26_cleaning_report": _report(),
    "e01_summary_statistics": _clean(
        "\nUNION ALL ".join(
            [
                _summary("MRP (₹)", "mrp", 100),
                _summary("Selling Price (₹)", "sp", 100),
                _summary("Discount %", "discount_percent", 1),
            ]
        )
    ),
    "e02_sku_distribution": _clean(
        f"SELECT category, COUNT(*) AS total_skus, {_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_total"
        " FROM clean GROUP BY category"
    ),
    "e03_discount_brackets": _clean(
        f"SELECT {_position('discount_percent', BRACKETS)} AS position,"
        f" {_bands('discount_percent', BRACKETS)} AS discount_bracket, COUNT(*) AS product_count,"
        f" {_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_total FROM clean GROUP BY 1, 2"
    ),
    "e04_stock_share": _clean(
        "SELECT CASE WHEN out_of_stock THEN 'Out of Stock' ELSE 'In Stock' END AS stock_status, COUNT(*) AS sku_count,"
        f" {_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_total FROM clean GROUP BY out_of_stock"
    ),
    "e05_stock_by_category": _clean(
        f"SELECT category, COUNT(*) AS total_skus, {OOS} AS oos_skus, {RATE} AS oos_rate_pct FROM clean GROUP BY category"
    ),
    "e06_weight_tiers": _clean(
        f"SELECT {_position('weight_in_gms', WEIGHTS)} AS position, {_bands('weight_in_gms', WEIGHTS)} AS weight_tier,"
        f" COUNT(*) AS product_count, {_avg('mrp', 2, 100)} AS avg_mrp, {_avg('sp', 2, 100)} AS avg_selling_price"
        " FROM clean GROUP BY 1, 2"
    ),
    "e07_price_per_gram_by_category": _clean(
        f"SELECT category, {_avg('ppg', 4, 10000)} AS avg_price_per_gram,"
        " CAST(MIN(ppg) AS DOUBLE) / CAST(10000 AS DOUBLE) AS min_price_per_gram,"
        " CAST(MAX(ppg) AS DOUBLE) / CAST(10000 AS DOUBLE) AS max_price_per_gram"
        " FROM clean WHERE ppg IS NOT NULL GROUP BY category"
    ),
    "e08_revenue_potential": _clean(
        f"SELECT {_money('SUM(rev)')} AS total_potential_revenue, {_avg('rev', 2, 100)} AS avg_revenue_per_sku,"
        " COUNT(*) FILTER (WHERE rev > 0) AS revenue_generating_skus FROM clean"
    ),
    "e09_revenue_by_category": _clean(
        f"SELECT category, {_money('SUM(rev)')} AS category_revenue,"
        f" {_pct('SUM(rev)', 'SUM(SUM(rev)) OVER ()')} AS pct_of_total_revenue FROM clean GROUP BY category"
    ),
    "b01_top_discounts": _clean(
        f"SELECT name, category, discount_percent, {MRP}, {SP}, {_money(MARKDOWN)} AS discount_amount FROM clean"
        " WHERE discount_percent > 0 ORDER BY discount_percent DESC, clean.mrp - sp DESC NULLS FIRST, sku_id LIMIT 10"
    ),
    "b02_discount_by_category": _clean(
        f"SELECT category, {_avg('discount_percent', 1)} AS avg_discount_pct, COUNT(*) AS total_skus,"
        " CAST(MIN(discount_percent) AS DOUBLE) AS min_discount, CAST(MAX(discount_percent) AS DOUBLE) AS max_discount"
        " FROM clean GROUP BY category"
    ),
    "b03_premium_low_discount": _clean(
        f"SELECT {MARKDOWN_ROW}, qty AS available_quantity, out_of_stock FROM clean"
        " WHERE clean.mrp > 50000 AND discount_percent < 10 ORDER BY clean.mrp DESC, sku_id LIMIT 20"
    ),
    "b04_revenue_by_category": _clean(
        f"SELECT category, {_money('SUM(rev)')} AS total_revenue, COUNT(*) AS total_skus,"
        f" {_avg('rev', 2, 100)} AS avg_revenue_per_sku,"
        f" {_pct('SUM(rev)', 'SUM(SUM(rev)) OVER ()')} AS revenue_share_pct"
        " FROM clean WHERE NOT out_of_stock GROUP BY category"
    ),
    "b05_stockout_ranking": _clean(
        f"SELECT category, COUNT(*) AS total_skus, {OOS} AS oos_count, {RATE} AS oos_rate_pct,"
        f" CAST(RANK() OVER (ORDER BY CAST({OOS} AS DOUBLE) / COUNT(*) DESC) AS INTEGER) AS oos_rank"
        " FROM clean GROUP BY category"
    ),
    "b06_best_value": _clean(
        f"SELECT category, name, weight_in_gms, {SP}, {PPG} AS price_per_gram, value_rank FROM ("
        " SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY category ORDER BY ppg, sku_id) AS INTEGER) AS value_rank"
        " FROM clean WHERE ppg > 0 AND NOT out_of_stock) WHERE value_rank <= 3"
    ),
    "b07_stockouts_by_discount_tier": _clean(
        f"SELECT {_position('discount_percent', TIERS)} AS position, {_bands('discount_percent', TIERS)} AS discount_tier,"
        f" COUNT(*) AS total_products, {OOS} AS oos_count, {RATE} AS oos_rate_pct FROM clean GROUP BY 1, 2"
    ),
    "b08_top_inventory_value": _clean(
        f"SELECT category, {_money('SUM(val)')} AS total_inventory_value_mrp,"
        f" {_money('SUM(rev)')} AS total_inventory_value_selling, CAST(SUM(qty) AS BIGINT) AS total_units,"
        f" {_money('SUM(val) - SUM(rev)')} AS discount_cost"
        " FROM clean WHERE NOT out_of_stock GROUP BY category ORDER BY SUM(rev) DESC NULLS FIRST, category LIMIT 5"
    ),
    "b09_largest_markdowns": _clean(
        f"SELECT {MARKDOWN_ROW}, {_money(MARKDOWN)} AS absolute_markdown, qty AS available_quantity FROM clean"
        " WHERE clean.mrp > 0 ORDER BY clean.mrp - sp DESC NULLS FIRST, sku_id LIMIT 15"
    ),
    "b10_quantity_by_category": _clean(
        f"SELECT category, {_avg('qty', 0)} AS avg_quantity, MIN(qty) AS min_quantity, MAX(qty) AS max_quantity,"
        " CAST(SUM(qty) AS BIGINT) AS total_units FROM clean WHERE NOT out_of_stock GROUP BY category"
    ),
    "b11_weight_tier_pricing": _clean(
        f"SELECT {_bands('weight_in_gms', NUMBERED_WEIGHTS)} AS weight_tier, COUNT(*) AS sku_count,"
        f" {_avg('mrp', 2, 100)} AS avg_mrp, {_avg('sp', 2, 100)} AS avg_selling_price,"
        f" {_avg('discount_percent', 1)} AS avg_discount_pct, {_avg('ppg', 4, 10000)} AS avg_price_per_gram"
        " FROM clean GROUP BY 1"
    ),
    "b12_critical_categories": _clean(
        f"SELECT category, COUNT(*) AS total_skus, {OOS} AS oos_count, {RATE} AS oos_rate_pct FROM clean"
        f" GROUP BY category HAVING {OOS} * 100 > COUNT(*) * 50"
    ),
    "b13_discount_histogram": _clean(
        "SELECT discount_percent // 10 * 10 AS discount_bracket_start, discount_percent // 10 * 10 + 9"
        f" AS discount_bracket_end, COUNT(*) AS product_count, {_avg('qty', 0)} AS avg_stock_in_bracket,"
        f" {RATE} AS oos_rate_pct FROM clean GROUP BY discount_percent // 10"
    ),
    "b14_pareto": f"WITH {RAW}, {CLEAN}, {RANKED}\n{PARETO} ORDER BY place LIMIT 20",
    "b14_pareto_all": f"WITH {RAW}, {CLEAN}, {RANKED}\n{PARETO}",
    "b15_cheap_and_stocked": _clean(
        f"SELECT name, category, {SP}, qty AS available_quantity, {_money('rev')} AS estimated_revenue FROM clean"
        " WHERE sp < 5000 AND NOT out_of_stock ORDER BY qty DESC NULLS FIRST, sku_id LIMIT 15"
    ),
    "b16_price_range": _clean(
        f"SELECT category, {_money('MIN(sp)')} AS min_price, {_money('MAX(sp)')} AS max_price,"
        f" {_money('MAX(sp) - MIN(sp)')} AS price_spread, {_avg('sp', 2, 100)} AS avg_price,"
        f" {_r('CAST(2 * PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY CAST(sp AS DOUBLE)) AS BIGINT)', '200', 2)}"
        " AS median_price FROM clean GROUP BY category"
    ),
    "b17_lost_revenue": f"WITH {RAW}, {CLEAN}, {LOST}\n"
    f"SELECT category, oos_sku_count, avg_category_price, avg_category_qty, {_money('paise')} AS estimated_lost_revenue"
    " FROM lost",
    "b18_stock_comparison": _clean(
        "SELECT CASE WHEN out_of_stock THEN 'Out of Stock' ELSE 'In Stock' END AS stock_status, COUNT(*) AS sku_count,"
        f" {_avg('discount_percent', 1)} AS avg_discount_pct, {_avg('mrp', 2, 100)} AS avg_mrp,"
        f" {_avg('sp', 2, 100)} AS avg_selling_price FROM clean GROUP BY out_of_stock"
    ),
    "b19_deep_discounts": _clean(
        f"SELECT {MARKDOWN_ROW}, {_money(MARKDOWN)} AS margin_lost, qty AS available_quantity, out_of_stock"
        " FROM clean WHERE discount_percent > 60"
    ),
    "b20_revenue_retention": _clean(
        f"SELECT category, {_money('SUM(rev)')} AS total_revenue, {_money('SUM(val)')} AS total_mrp_value,"
        f" {_pct('SUM(rev)', 'SUM(val)')} AS revenue_retention_pct, {_avg('discount_percent', 1)} AS avg_discount_pct,"
        " COUNT(*) AS total_skus FROM clean WHERE NOT out_of_stock AND mrp > 0 GROUP BY category"
    ),
    "b21_executive_summary": _clean(
        "SELECT COUNT(*) AS total_skus, COUNT(DISTINCT category) AS total_categories,"
        f" COUNT(DISTINCT name) AS unique_products, {_money('SUM(rev)')} AS total_potential_revenue,"
        f" {_money('SUM(val)')} AS total_inventory_at_mrp, {_avg('discount_percent', 1)} AS avg_discount_pct,"
        f" {OOS} AS total_oos_skus, {RATE} AS oos_rate_pct,"
        f" {_avg('CASE WHEN NOT out_of_stock THEN qty END', 0)} AS avg_stock_level,"
        f" {_avg('ppg', 4, 10000)} AS avg_price_per_gram FROM clean"
    ),
    "b21_sketched_products": _clean(
        "SELECT category, out_of_stock, COUNT(DISTINCT name) AS unique_products, TRUE AS estimate_near"
        " FROM clean GROUP BY category, out_of_stock"
    ),
    "f1_discount_stockout_ratio": f"WITH {RAW}, {CLEAN}"
    """, counts AS (
    SELECT COUNT(*) FILTER (WHERE discount_percent > 40) AS deep,
        COUNT(*) FILTER (WHERE discount_percent > 40 AND out_of_stock) AS deep_oos,
        COUNT(*) FILTER (WHERE discount_percent = 0) AS none,
        COUNT(*) FILTER (WHERE discount_percent = 0 AND out_of_stock) AS none_oos
    FROM clean)
"""
    f"SELECT {_pct('deep_oos', 'deep')} AS deep_oos_rate_pct, {_pct('none_oos', 'none')} AS undiscounted_oos_rate_pct,"
    f" {_r('deep_oos * none', 'none_oos * deep', 2)} AS oos_ratio FROM counts",
    "f2_leading_category_share": f"WITH {RAW}, {CLEAN}"
    ", shares AS (SELECT category, SUM(rev) AS revenue, SUM(SUM(rev)) OVER () AS total FROM clean"
    " WHERE NOT out_of_stock GROUP BY category ORDER BY revenue DESC, category LIMIT 2)\n"
    f"SELECT {_pct('SUM(revenue)', 'MAX(total)')} AS revenue_share_pct FROM shares",
    "f3_deep_discount_count": _clean("SELECT COUNT(*) AS deep_discount_skus FROM clean WHERE discount_percent > 60"),
    "f4_total_lost_revenue": f"WITH {RAW}, {CLEAN}, {LOST}\nSELECT {_money('SUM(paise)')} AS total_lost_revenue FROM lost",
    "f5_overall_stockout_rate": _clean(f"SELECT {RATE} AS oos_rate_pct FROM clean"),
    "j1_priced": _raw("SELECT sku_id, mrp, discounted_selling_price FROM raw WHERE mrp <> 0"),
    "j2_fixed_discounts": _dash("SELECT sku_id, discount_percent, mrp, sp AS discounted_selling_price FROM priced"),
    "j3_filled_weights": _dash("SELECT sku_id, weight_in_gms FROM weighed"),
    "j4_rupees": _dash(f"SELECT sku_id, {MRP}, {SP} FROM dash"),
    "j5_derived_columns": _dash(
        f"SELECT sku_id, {PPG} AS price_per_gram, {_money('rev')} AS estimated_revenue FROM dash"
    ),
    "d01_kpis": _dash(f"SELECT {CARDS} FROM dash"),
    "d02_categories": _dash("SELECT DISTINCT category FROM dash"),
    "d03_revenue_by_category": _dash(f"SELECT category, {_money('SUM(rev)')} AS revenue FROM dash GROUP BY category"),
    "d04_oos_by_category": _dash(DASH_OOS),
    "d04_oos_top_categories": _dash(f"{DASH_OOS} ORDER BY oos_rate DESC, category LIMIT 5"),
    "d05_discount_distribution": _dash(DISTRIBUTION),
    "d06_discount_vs_oos": _dash(TIER_RATES),
    "d05_d06_outside_ranges": _dash(
        "SELECT 'discount_distribution' AS mart, COUNT(*) - COUNT(*) FILTER (WHERE discount_percent BETWEEN 0 AND 79)"
        " AS listings_outside, MAX(discount_percent) FILTER (WHERE discount_percent > 79) AS highest_discount FROM dash"
        " UNION ALL SELECT 'discount_vs_oos', COUNT(*) - COUNT(*) FILTER (WHERE discount_percent BETWEEN 0 AND 100),"
        " MAX(discount_percent) FILTER (WHERE discount_percent > 100) FROM dash"
    ),
    "d07_avg_discount_by_category": _dash(
        f"SELECT category, {_avg('discount_percent', 1)} AS avg_discount FROM dash GROUP BY category"
    ),
    "d08_stock_by_category": _dash(
        f"SELECT category, COUNT(*) - {OOS} AS in_stock, {OOS} AS out_of_stock FROM dash GROUP BY category"
    ),
    "d09_top_products": _dash(f"SELECT {PRODUCT} FROM dash ORDER BY rev DESC, sku_id LIMIT 10"),
    "d10_scatter": _dash(
        f"SELECT {MRP}, discount_percent, category, name FROM dash WHERE NOT out_of_stock AND dash.mrp > 0"
    ),
    "d11_all_rows": _dash(f"SELECT {CLEAN_ROW} FROM dash"),
    "d12_kpis_by_category": _dash(f"SELECT category, {CARDS} FROM dash GROUP BY category"),
    "d13_top_products_by_category": _dash(
        f"SELECT {PRODUCT}, position FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY category"
        " ORDER BY rev DESC, sku_id) AS INTEGER) AS position FROM dash) WHERE position <= 10"
    ),
    "d13_top_products_of_one_category": _dash(
        f"SELECT {PRODUCT} FROM dash WHERE category = (SELECT MIN(category) FROM dash) ORDER BY rev DESC, sku_id LIMIT 10"
    ),
    "m1_total_skus": _light("SELECT COUNT(sku_id) AS total_skus FROM light"),
    "m2_revenue": _light(f"SELECT {_money(f'SUM({SALE})')} AS est_revenue FROM light"),
    "m3_stockout_rate": _light(f"SELECT {FRACTION} AS out_of_stock_rate FROM light"),
    "m4_row_level_revenue": _raw(
        f"SELECT sku_id, {_money('mrp')} AS mrp_rupees, {_money('discounted_selling_price')} AS selling_price_rupees,"
        " CASE WHEN out_of_stock = 'True' THEN 0 ELSE"
        f" {_money('CAST(discounted_selling_price AS BIGINT) * available_quantity')} END AS estimated_revenue FROM raw"
    ),
    "m5_by_category": _raw(
        "SELECT category, CAST(COALESCE(SUM(CAST(discounted_selling_price AS BIGINT) * available_quantity)"
        " FILTER (WHERE COALESCE(out_of_stock, '') <> 'True'), 0) AS DOUBLE) / CAST(100 AS DOUBLE) AS estimated_revenue,"
        " CAST(COUNT(*) FILTER (WHERE out_of_stock = 'True') AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS out_of_stock_rate"
        " FROM raw GROUP BY category"
    ),
    "m6_discount_bins": _raw(
        "SELECT CAST(FLOOR(discount_percent / CAST(10 AS DOUBLE)) * 10 AS INTEGER) AS bin_start, COUNT(sku_id) AS skus"
        " FROM raw GROUP BY 1"
    ),
    "m7_light_clean": _light(
        f"SELECT sku_id, category, name, {MRP}, discount_percent, {SP}, weight_in_gms, qty AS available_quantity,"
        " out_of_stock FROM light"
    ),
}

# How the reports that end in a sort are sorted. Lists cut to a length are sorted in their SQL.
IN_SQL = ""
ORDER: dict[str, str] = {
    "s08_preview": IN_SQL,
    "c02_skus_by_category": "sku_count DESC, category NULLS FIRST",
    "c03_schema_overview": "ordinal_position",
    "c04_preview": IN_SQL,
    "c25_clean_preview": IN_SQL,
    "e02_sku_distribution": "total_skus DESC, category NULLS FIRST",
    "e03_discount_brackets": "position NULLS LAST",
    "e05_stock_by_category": "oos_rate_pct DESC, category NULLS FIRST",
    "e06_weight_tiers": "position NULLS LAST",
    "e07_price_per_gram_by_category": "avg_price_per_gram DESC, category NULLS FIRST",
    "e09_revenue_by_category": "category_revenue DESC NULLS FIRST, category NULLS FIRST",
    "b01_top_discounts": IN_SQL,
    "b02_discount_by_category": "avg_discount_pct DESC NULLS FIRST, category NULLS FIRST",
    "b03_premium_low_discount": IN_SQL,
    "b04_revenue_by_category": "total_revenue DESC NULLS FIRST, category NULLS FIRST",
    "b05_stockout_ranking": "oos_rate_pct DESC, category NULLS FIRST",
    "b06_best_value": "category NULLS FIRST, value_rank",
    "b07_stockouts_by_discount_tier": "position NULLS LAST",
    "b08_top_inventory_value": IN_SQL,
    "b09_largest_markdowns": IN_SQL,
    "b10_quantity_by_category": "avg_quantity DESC NULLS FIRST, category NULLS FIRST",
    "b11_weight_tier_pricing": "weight_tier NULLS LAST",
    "b12_critical_categories": "oos_rate_pct DESC, category NULLS FIRST",
    "b13_discount_histogram": "discount_bracket_start NULLS LAST",
    "b14_pareto": IN_SQL,
    "b15_cheap_and_stocked": IN_SQL,
    "b16_price_range": "price_spread DESC NULLS FIRST, category NULLS FIRST",
    "b17_lost_revenue": "estimated_lost_revenue DESC NULLS FIRST, category NULLS FIRST",
    "b19_deep_discounts": "discount_percent DESC, margin_lost DESC NULLS FIRST",
    "b20_revenue_retention": "revenue_retention_pct DESC NULLS FIRST, category NULLS FIRST",
    "d02_categories": "category NULLS FIRST",
    "d03_revenue_by_category": "revenue DESC NULLS LAST, category NULLS FIRST",
    "d04_oos_by_category": "oos_rate DESC, category NULLS FIRST",
    "d04_oos_top_categories": "oos_rate DESC, category NULLS FIRST",
    "d05_discount_distribution": "bucket_start",
    "d06_discount_vs_oos": "tier_index",
    "d07_avg_discount_by_category": "category NULLS FIRST",
    "d08_stock_by_category": "category NULLS FIRST",
    "d09_top_products": IN_SQL,
    "d12_kpis_by_category": "category NULLS FIRST",
    "d13_top_products_by_category": "category NULLS FIRST, position",
    "d13_top_products_of_one_category": IN_SQL,
}
# columns that leave ties open: the sort decides them by a key that the report doesn't show
SORTED_BY = {"b19_deep_discounts": ["discount_percent", "margin_lost"]}

# The query whose rows each written dashboard table holds.
MART_QUERIES = {
    "kpis": "d01_kpis",
    "kpis_by_category": "d12_kpis_by_category",
    "categories": "d02_categories",
    "revenue_by_category": "d03_revenue_by_category",
    "oos_by_category": "d04_oos_by_category",
    "oos_top_categories": "d04_oos_top_categories",
    "discount_distribution": "d05_discount_distribution",
    "discount_vs_oos": "d06_discount_vs_oos",
    "outside_ranges": "d05_d06_outside_ranges",
    "avg_discount_by_category": "d07_avg_discount_by_category",
    "stock_by_category": "d08_stock_by_category",
    "top_products": "d09_top_products",
    "top_products_by_category": "d13_top_products_by_category",
    "all_rows": "d11_all_rows",
    "scatter": "d10_scatter",
}
