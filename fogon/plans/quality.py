"""Data-quality checks as tables: (check_name, value, ok).

Every check is an aggregate, so a report is one small DataFrame however large the
facts are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogon.plans.cubes import CUBE_KEYS
from fogon.schemas import (
    FOREIGN_KEYS,
    PRIMARY_KEYS,
    UNIQUE_KEYS,
    required_columns,
)

Tables = dict[str, DataFrame]


def _row(df: DataFrame, name: str, value: Column, ok: Column) -> DataFrame:
    """One check row from a one-row aggregate of ``df``."""
    return df.agg(value.cast("double").alias("value")).select(
        F.lit(name).alias("check_name"), "value", ok.alias("ok")
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _is_zero() -> Column:
    return F.col("value") == 0


def row_counts(facts: Tables) -> DataFrame:
    return _union(
        [
            df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            for name, df in facts.items()
        ]
    )


def not_empty(df: DataFrame, name: str) -> DataFrame:
    return _row(df, f"{name} not empty", F.count("*"), F.col("value") > 0)


def orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows whose key is NULL or not in the parent.

    The child is reduced to one row per key before the anti join, so a hot key is one
    row and the child's rows are never shuffled whole.
    """
    keys = child.groupBy(key).agg(F.count("*").alias("n"))
    missing = keys.join(parent.select(key), key, "left_anti")
    return _row(missing, name, F.coalesce(F.sum("n"), F.lit(0)), _is_zero())


def grand_total_matches_leaves(cube_revenue: DataFrame) -> DataFrame:
    """|grand total - sum of leaves| of the revenue cube, in one pass."""
    grand = F.sum(F.when(F.col("grp_flag") == 15, F.col("revenue")))
    leaves = F.coalesce(F.sum(F.when(F.col("grp_flag") == 0, F.col("revenue"))), F.lit(0))
    return _row(
        cube_revenue,
        "revenue grand total equals leaf sum",
        F.abs(grand - leaves),
        F.coalesce(F.col("value") < 0.01, F.lit(False)),
    )


def no_negative_amounts(fact_orders: DataFrame) -> DataFrame:
    return _row(
        fact_orders, "no negative net amounts", F.count_if(F.col("net_amount") < 0), _is_zero()
    )


def cancel_rate_in_range(cube_status: DataFrame) -> DataFrame:
    return _row(
        cube_status.where("grp_flag = 3"),
        "overall cancel rate in 0..100",
        F.max("cancel_rate_pct"),
        F.coalesce(F.col("value").between(0, 100), F.lit(False)),
    )


def duplicate_keys(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Number of key values that occur more than once (NULLs compare equal)."""
    repeated = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return _row(repeated, name, F.count("*"), _is_zero())


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """NULLs in the columns that must have a value: one pass for all of them."""
    required = required_columns(table)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in required])
    )
    return counted.select(pairs.alias("p")).select(
        F.concat(F.lit(f"not null {table}."), F.col("p.c")).alias("check_name"),
        F.col("p.n").cast("double").alias("value"),
        (F.col("p.n") == 0).alias("ok"),
    )


def foreign_keys(df: DataFrame, table: str, parents: Tables) -> DataFrame:
    """Rows of ``df`` whose key is NULL or not in the parent, for every column of ``parents``.

    One pass: the keys of all columns are reduced to one row per (column, key) before they
    meet the keys of all parents in one anti join.
    """
    def key(column: str) -> Column:
        return F.struct(F.lit(column).alias("c"), F.col(column).cast("bigint").alias("k"))

    keys = df.select(F.explode(F.array(*[key(c) for c in parents])).alias("p")).select("p.*")
    known = _union([parent.select(key(c).alias("p")).select("p.*") for c, parent in parents.items()])
    missing = keys.groupBy("c", "k").agg(F.count("*").alias("n")).join(known, ["c", "k"], "left_anti")
    counted = missing.agg(*[F.sum(F.when(F.col("c") == c, F.col("n"))).alias(c) for c in parents])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(c, F.lit(0)).alias("n")) for c in parents])
    )
    return counted.select(pairs.alias("p")).select(
        F.concat(F.lit(f"foreign key {table}."), F.col("p.c")).alias("check_name"),
        F.col("p.n").cast("double").alias("value"),
        (F.col("p.n") == 0).alias("ok"),
    )


def constraints(tables: Tables) -> DataFrame:
    """Primary keys, unique ids, foreign keys and required columns of the star schema."""
    checks = []
    for name, df in tables.items():
        if name in PRIMARY_KEYS:
            checks.append(duplicate_keys(df, PRIMARY_KEYS[name], f"primary key {name}"))
        if name in UNIQUE_KEYS:
            checks.append(
                duplicate_keys(df, UNIQUE_KEYS[name], f"unique {name}.{UNIQUE_KEYS[name][0]}")
            )
        parents = {c: tables[p] for c, p in FOREIGN_KEYS.get(name, {}).items() if p in tables}
        if parents:
            checks.append(foreign_keys(df, name, parents))
        if name in PRIMARY_KEYS:
            checks.append(null_counts(df, name))
    return _union(checks)


def cube_keys(cubes: Tables) -> DataFrame:
    """Each cube's identifying columns are unique."""
    return _union(
        [duplicate_keys(df, CUBE_KEYS[name], f"unique rows {name}") for name, df in cubes.items()]
    )


def report(
    fact_orders: DataFrame,
    fact_order_items: DataFrame,
    dim_product: DataFrame,
    cube_revenue: DataFrame,
    cube_status: DataFrame,
) -> DataFrame:
    """The run-time checks of a load."""
    on = "product_key" if "product_key" in fact_order_items.columns else "product_id"
    return _union(
        [
            not_empty(fact_orders, "fact_orders"),
            not_empty(fact_order_items, "fact_order_items"),
            orphans(fact_order_items, dim_product, on, "order items have a product"),
            grand_total_matches_leaves(cube_revenue),
            no_negative_amounts(fact_orders),
            cancel_rate_in_range(cube_status),
        ]
    )


def enforce(checks: DataFrame) -> list[tuple[str, float, bool]]:
    """Print every check and raise when one fails. Reads one row per check."""
    rows = [(r["check_name"], r["value"], r["ok"]) for r in checks.collect()]
    for name, value, ok in rows:
        print(f"[quality] {name}: {value} -> {'OK' if ok else 'FAIL'}")
    failures = [name for name, _, ok in rows if not ok]
    if failures:
        raise ValueError(f"data-quality failures: {failures}")
    return rows
