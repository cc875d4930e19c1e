"""Checks over the whole star schema, stated one SELECT per check."""

from __future__ import annotations

from fogon.plans.cubes import CUBE_KEYS
from fogon.schemas import (
    ANALYSES, DIMENSIONS, FACTS, FOREIGN_KEYS, PRIMARY_KEYS, UNIQUE_KEYS, required_columns,
)
from oracle import cubes as c
from oracle.star import over_star

CUBES = {
    "cube_revenue_time_category": c.REVENUE,
    "cube_sales_by_location": c.LOCATION,
    "cube_product_frequency": c.FREQUENCY,
    "cube_orders_status": c.STATUS,
    "cube_peak_hours": c.PEAK,
    "cube_customer_activity": c.ACTIVITY,
}
ANALYSIS_SQL = {
    "analysis_consumption_trends": c.TRENDS,
    "analysis_peak_hours": c.PEAK_ANALYSIS,
    "analysis_monthly_growth": c.GROWTH,
}


def _zero(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS check_name, CAST(v AS DOUBLE) AS value, v = 0 AS ok FROM ({sql} AS t(v))"


def _duplicates(table: str, keys: list[str], name: str) -> str:
    cols = ", ".join(keys)
    return _zero(name, f"(SELECT count(*) FROM (SELECT {cols} FROM {table} GROUP BY {cols} HAVING count(*) > 1))")


def _orphans(child: str, parent: str, key: str, name: str) -> str:
    return _zero(
        name, f"(SELECT count(*) FROM {child} a LEFT JOIN {parent} b ON a.{key} = b.{key} WHERE b.{key} IS NULL)"
    )


def constraint_rows() -> list[str]:
    rows = []
    for table in (*DIMENSIONS, *FACTS):
        rows.append(_duplicates(table, PRIMARY_KEYS[table], f"primary key {table}"))
        if table in UNIQUE_KEYS:
            rows.append(_duplicates(table, UNIQUE_KEYS[table], f"unique {table}.{UNIQUE_KEYS[table][0]}"))
        for column, parent in FOREIGN_KEYS.get(table, {}).items():
            rows.append(_orphans(table, parent, column, f"foreign key {table}.{column}"))
        for column in required_columns(table):
            rows.append(
                _zero(f"not null {table}.{column}", f"(SELECT count(*) FROM {table} WHERE {column} IS NULL)")
            )
    return rows


NOT_EMPTY = [
    f"SELECT '{t} not empty' AS check_name, CAST(count(*) AS DOUBLE) AS value, count(*) > 0 AS ok FROM {t}"
    for t in ("fact_orders", "fact_order_items")
]
ORPHANS = _orphans("fact_order_items", "dim_product", "product_key", "order items have a product")
GRAND = (
    "SELECT 'revenue grand total equals leaf sum' AS check_name, v AS value, v < 0.01 AS ok FROM (SELECT abs("
    "(SELECT CAST(revenue AS DECIMAL(18,2)) FROM cube_revenue WHERE grp_flag = 15) - "
    "(SELECT coalesce(sum(CAST(revenue AS DECIMAL(18,2))), 0) FROM cube_revenue WHERE grp_flag = 0))::DOUBLE AS v)"
)
NEGATIVE = _zero("no negative net amounts", "(SELECT count(*) FROM fact_orders WHERE net_amount < 0)")
RATE = (
    "SELECT 'overall cancel rate in 0..100' AS check_name, cancel_rate_pct AS value, "
    "cancel_rate_pct BETWEEN 0 AND 100 AS ok FROM cube_status WHERE grp_flag = 3"
)
CUBE_CTES = {"cube_revenue": c.REVENUE, "cube_status": c.STATUS}


def _union(rows: list[str]) -> str:
    return "\nUNION ALL ".join(rows)


def _counts(tables) -> str:
    return _union([f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in tables])


def _levels(cube: str) -> str:
    revenue = "realised_revenue" if cube == "cube_orders_status" else "revenue"
    return (
        f"SELECT '{cube}' AS cube, grp_flag, count(*) AS n_rows, "
        f"CAST(sum(CAST({revenue} AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM {cube} GROUP BY grp_flag"
    )


SQL = {
    "dq_row_counts": over_star(_counts(FACTS)),
    "dq_not_empty": over_star(_union(NOT_EMPTY)),
    "dq_orphans": over_star(ORPHANS),
    "dq_grand_total": over_star(GRAND, CUBE_CTES),
    "dq_no_negative": over_star(NEGATIVE),
    "dq_cancel_rate_range": over_star(RATE, CUBE_CTES),
    "dq_constraints": over_star(_union(constraint_rows())),
    "dq_cube_keys": over_star(
        _union([_duplicates(t, CUBE_KEYS[t], f"unique rows {t}") for t in CUBES]), CUBES
    ),
    "dq_report": over_star(_union([*NOT_EMPTY, ORPHANS, GRAND, NEGATIVE, RATE]), CUBE_CTES),
    "refresh_cubes": over_star(_union([_levels(t) for t in CUBES]), CUBES),
    "load_serving": over_star(
        _counts((*DIMENSIONS, *FACTS, *ANALYSES, *CUBES)), {**ANALYSIS_SQL, **CUBES}
    ),
    "catalog_register": over_star(
        _counts((*DIMENSIONS, *FACTS, *ANALYSES, *CUBES)), {**ANALYSIS_SQL, **CUBES}
    ),
}
