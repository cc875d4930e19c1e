"""The load, step by step: bronze mirror, dimensions, facts, analyses, cubes, checks.

Each step returns what it wrote, so a scheduler can run them in order or a notebook
can run one. Row counts come from the written tables (Parquet footers), not from a
second run of the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogon.plans import analyses, cubes, dims, facts, quality
from fogon.operators.staging import stage, staged_here
from fogon.schemas import ANALYSES, CUBES, DIMENSIONS, FACTS, SOURCE_TABLES, conform
from fogon.sources.lake import NULL_PARTITION, Lake, fingerprint

Tables = dict[str, DataFrame]

_FACT_SOURCES = {
    "fact_orders": ("orders",),
    "fact_order_items": ("order_items", "orders"),
    "fact_reservations": ("reservations",),
}


def extract(read: Callable[[str], DataFrame], lake: Lake, tables=SOURCE_TABLES) -> Tables:
    """Mirror the source tables to bronze as they are."""
    return {name: lake.write(read(name), "bronze", name) for name in tables}


def build_dimensions(lake: Lake) -> Tables:
    src = {name: lake.read("bronze", name) for name in SOURCE_TABLES}
    location = lake.write(dims.dim_location(src["locations"]), "silver", "dim_location")
    built = {
        "dim_date": dims.dim_date(src["orders"], src["reservations"]),
        "dim_time": dims.dim_time(lake.spark),
        "dim_product": dims.dim_product(src["products"]),
        "dim_user": dims.dim_user(src["users"], location),
        "dim_order_status": dims.dim_order_status(lake.spark),
    }
    written = {name: lake.write(df, "silver", name) for name, df in built.items()}
    return {"dim_location": location, **written}


def build_facts(lake: Lake, wanted=FACTS) -> Tables:
    sources = sorted({s for f in wanted for s in _FACT_SOURCES[f]})
    src = {name: lake.read("bronze", name) for name in sources}
    dim = {name: lake.read("silver", name) for name in DIMENSIONS}
    user, location, status = dim["dim_user"], dim["dim_location"], dim["dim_order_status"]
    written: Tables = {}

    def items() -> DataFrame:
        # The orders of this load are looked up already.
        made = facts.fact_order_items(
            src["order_items"], src["orders"], user, dim["dim_product"], location, status, written.get("fact_orders")
        )
        # A table that is there is compared with the rows before they are written.
        return stage(made, "order-items") if lake.manifest("gold", "fact_order_items") else made

    build = {
        "fact_orders": lambda: facts.fact_orders(src["orders"], user, location, status),
        "fact_order_items": items,
        "fact_reservations": lambda: facts.fact_reservations(src["reservations"], user, location),
    }
    # Kept by month: a load replaces the months whose rows changed.
    for name in sorted(wanted, key=FACTS.index):
        df = build[name]().withColumn("month_key", cubes.month_key())
        written[name] = lake.write_changed(df, "gold", name, "month_key")
    return {name: written[name] for name in wanted}


def run_analyses(lake: Lake) -> Tables:
    orders = cubes.orders_base(lake.read("gold", "fact_orders"))
    items = cubes.items_with_product(
        lake.read("gold", "fact_order_items"), lake.read("silver", "dim_product")
    )
    built = {
        "analysis_consumption_trends": analyses.consumption_trends(items),
        "analysis_peak_hours": analyses.peak_hours(orders),
        "analysis_monthly_growth": analyses.monthly_growth(orders),
    }
    return {name: lake.write(df, "gold", name) for name, df in built.items()}


def _refresh_states(lake: Lake, names: list[str]) -> Tables:
    """Bring the named state tables up to date with the gold facts.

    A state remembers from which version of each month of its fact, and from which rows of the
    dimensions, it was made. Months of which that differs are made anew, in one pass over
    those months of each fact; other months are neither read nor written.
    """
    used = {f: lake.manifest("gold", f) for f in sorted({cubes.STATES[n] for n in names})}
    dims = {t: lake.read("silver", t) for t in ("dim_location", "dim_product", "dim_order_status")}
    prints = {t: fingerprint(df)[""] for t, df in dims.items()}
    now = {n: {"source": used[cubes.STATES[n]]["parts"], "dims": prints} for n in names}
    stale: dict[str, set] = {}
    for name in names:
        parts = now[name]["source"]
        before = (lake.manifest("gold", name) or {}).get("notes", {})
        known = before.get("source", {}) if before.get("dims") == prints else {}
        changed = {m for m in parts.keys() | known.keys() if parts.get(m) != known.get(m)}
        # All months of a state that was never made, or under other dimensions.
        stale[name] = changed if known else changed | set((lake.manifest("gold", name) or {"parts": {}})["parts"])

    def months(fact: str) -> DataFrame | None:
        if fact not in used:
            return None
        wanted = set().union(*[stale[n] for n in names if cubes.STATES[n] == fact])
        rows = lake.open("gold", fact, used[fact])
        keys = sorted(int(m) for m in wanted if m != NULL_PARTITION)
        return rows if wanted >= set(used[fact]["parts"]) else rows.where(F.col("month_key").isin(keys))

    todo = [n for n in names if stale[n] or lake.manifest("gold", n) is None]
    built = cubes.states(
        months("fact_orders"), months("fact_order_items"), dims["dim_location"], dims["dim_product"],
        dims["dim_order_status"], todo,
    ) if todo else {}
    for name, df in built.items():
        lake.write_parts(df, "gold", name, "month_key", stale[name], now[name])
    return {name: lake.read("gold", name) for name in names}


def refresh_cubes(lake: Lake, names=CUBES) -> Tables:
    """The cubes after the gold facts: states of the changed months are recomputed, and every
    cube is merged from the states of all months as a new version of its table."""
    states = _refresh_states(lake, cubes.states_of(names))
    return {name: lake.write(df, "gold", name) for name, df in cubes.from_states(states, names).items()}


def load_serving(lake: Lake, write: Callable[[DataFrame, str], None]) -> list[str]:
    """Hand dimensions, facts, analyses and cubes to ``write`` in their serving contract."""
    order = [("silver", t) for t in DIMENSIONS] + [("gold", t) for t in (*FACTS, *ANALYSES, *CUBES)]
    for zone, table in order:
        write(conform(lake.read(zone, table), table), table)
    return [table for _, table in order]


def check(lake: Lake) -> DataFrame:
    """All data-quality checks over the written lake."""
    tables = {t: lake.read("silver", t) for t in DIMENSIONS}
    tables |= {t: lake.read("gold", t) for t in FACTS}
    built = {name: lake.read("gold", name) for name in cubes.CUBE_KEYS}
    return (
        quality.report(
            tables["fact_orders"],
            tables["fact_order_items"],
            tables["dim_product"],
            built["cube_revenue_time_category"],
            built["cube_orders_status"],
        )
        .unionByName(quality.constraints(tables))
        .unionByName(quality.cube_keys(built))
    )


def run(
    read: Callable[[str], DataFrame],
    lake: Lake,
    enforce: bool = True,
    with_analyses: bool = True,
    cube_names=CUBES,
) -> DataFrame:
    """The whole load; returns (table_name, n_rows) of everything in silver and gold.

    What the steps stage is removed as soon as their tables are written.
    """
    with staged_here():
        extract(read, lake)
        written = build_dimensions(lake)
        written |= build_facts(lake)
        if with_analyses:
            written |= run_analyses(lake)
        if cube_names:
            written |= refresh_cubes(lake, cube_names)
    if enforce:
        quality.enforce(check(lake))
    return counts(written)


def counts(tables: Tables) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows"
        )
        out = row if out is None else out.unionByName(row)
    return out
