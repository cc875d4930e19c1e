"""Zone-aware, load-balanced assignment of orders to couriers, fully distributed.

The rule: zones are served from the largest to the smallest; an order goes to a
courier that already serves its zone and has room, else to the least-loaded courier
with room, and when all are full to the least-loaded one. While a zone is placed at
most one of its couriers has room, so each zone is a run of segments: top up the
least-loaded courier, then the next. Only zone *counts* are needed to lay the segments
out; every order then finds its courier from its position within its zone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogon.operators.dense_key import dense_key


# The helpers travel to the Python workers with the task, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def zone_segments(
    counts: list[int], n_couriers: int, capacity: int
) -> Iterator[tuple[int, int, int, int, bool]]:
    """(zone, first position, end position, courier, spilled) for zones in serving order.

    ``courier`` is where the segment starts. A plain segment moves on to the next
    courier after every ``capacity`` orders (only a run of empty couriers is longer than
    one); a spilled one moves on after every order and wraps around.
    """
    fresh = 0  # couriers fresh..n-1 are empty
    open_loads: list[tuple[int, int]] = []  # (load, courier) with room, not empty
    spilled = 0
    for zone, count in enumerate(counts):
        at = 0
        while at < count:
            if fresh < n_couriers:
                whole = min(n_couriers - fresh, -(-(count - at) // capacity))
                taken = min(count - at, whole * capacity)
                yield zone, at, at + taken, fresh, False
                last_load = taken - (whole - 1) * capacity
                fresh += whole
                if last_load < capacity:
                    open_loads.append((last_load, fresh - 1))
            elif open_loads:
                load, courier = min(open_loads)
                open_loads.remove((load, courier))
                taken = min(count - at, capacity - load)
                yield zone, at, at + taken, courier, False
                if load + taken < capacity:
                    open_loads.append((load + taken, courier))
            else:
                taken = count - at
                yield zone, at, count, spilled % n_couriers, True
                spilled += taken
            at += taken


_PLAN_TYPE = (
    "struct<fleet: bigint, segments: array<struct<zone: int, from_pos: bigint, to_pos: bigint, "
    "start_courier: bigint, spilled: boolean>>>"
)
_SEGMENT_FIELDS = ("zone", "from_pos", "to_pos", "start_courier", "spilled")


def plan_segments(counts: str | Column, n_couriers: int, capacity: int, grow: bool) -> Column:
    """Fleet size and segments per batch from its (negated, sorted) zone counts."""

    def lay_out(batches: pd.Series) -> pd.DataFrame:
        fleets, plans = [], []
        for negated in batches:
            sizes = [-int(n) for n in negated]
            needed = -(-sum(sizes) // capacity)
            fleet = max(n_couriers, needed) if grow else n_couriers
            fleets.append(fleet)
            plans.append(
                [
                    dict(zip(_SEGMENT_FIELDS, segment, strict=True))
                    for segment in zone_segments(sizes, fleet, capacity)
                ]
            )
        return pd.DataFrame({"fleet": fleets, "segments": plans})

    return F.pandas_udf(lay_out, _PLAN_TYPE)(counts)


def assign_couriers(
    orders: DataFrame,
    batch: list[str],
    zone: str = "zone",
    order_id: str = "order_id",
    n_couriers: int = 4,
    capacity: int = 10,
    grow_fleet: bool = False,
) -> DataFrame:
    """Add ``courier`` (0-based, per batch) to every order.

    Orders of a zone are taken by ``order_id``; zones of equal size by their smallest
    ``order_id``. ``batch`` columns (for example the delivery day) are planned
    independently; an empty list plans everything together. ``grow_fleet`` raises the
    number of couriers of a batch to what its orders need, so no load passes
    ``capacity``; without it the surplus is spread evenly.
    """
    order_cols = [*batch, zone, order_id]
    # Global rank in (batch, zone, order_id) order: a zone's positions are its ranks
    # minus its first rank. A zone with a large share of all orders spans many tasks.
    ranked = dense_key(orders, "_rank", order_cols)
    zones = ranked.groupBy(*batch, zone).agg(
        F.count("*").alias("n"),
        F.min("_rank").alias("first_rank"),
        F.min(order_id).alias("first_order"),
    )
    # One row per batch: its zones in serving order, bounded by the zones there are.
    plan = zones.groupBy(*batch).agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("n")).alias("n"), "first_order", zone, "first_rank"))
        ).alias("zones")
    )
    segment = plan_segments("zones.n", n_couriers, capacity, grow_fleet)
    segments = (
        plan.withColumn("plan", segment)
        .select(
            *[F.col(b).alias(f"seg_{b}") for b in batch],
            "zones",
            F.col("plan.fleet").alias("fleet"),
            F.explode("plan.segments").alias("s"),
        )
        .withColumn("z", F.element_at("zones", F.col("s.zone") + 1))
        .select(
            *[f"seg_{b}" for b in batch],
            F.col(f"z.{zone}").alias(f"seg_{zone}"),
            F.col("z.first_rank").alias("first_rank"),
            "s.from_pos",
            "s.to_pos",
            "s.start_courier",
            "s.spilled",
            "fleet",
        )
    )
    position = F.col("_rank") - F.col("first_rank")
    within = position - F.col("from_pos")
    step = F.call_function("div", within, F.lit(capacity))
    courier = F.when(
        F.col("spilled"), F.pmod(F.col("start_courier") + within, F.col("fleet"))
    ).otherwise(F.col("start_courier") + step)
    # NULL-safe, so an order without a zone or day is planned too. Segments are few per
    # zone; the orders of a large zone are spread by AQE's skew split.
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"seg_{k}")) for k in [*batch, zone]])
    return (
        ranked.join(segments, same)
        .where((position >= F.col("from_pos")) & (position < F.col("to_pos")))
        .withColumn("courier", courier)
        .select(*orders.columns, "courier")
    )
