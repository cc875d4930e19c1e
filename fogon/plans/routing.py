"""Delivery routing: pick deliverable orders, assign couriers, sequence the stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogon.functions.calendar import date_key, local_timestamp
from fogon.functions.geo import AVG_SPEED_KMH, KITCHEN_LAT, KITCHEN_LNG, haversine_km
from fogon.operators.assignment import assign_couriers
from fogon.operators.sequencing import plan_route

# Orders in these states still wait for a courier.
DELIVERABLE = ("pending", "preparing")


def deliverable(orders: DataFrame, locations: DataFrame) -> DataFrame:
    """Orders to deliver with customer coordinates, zone and delivery day."""
    return (
        orders.where(F.col("status").isin(*DELIVERABLE))
        .select(
            "order_id",
            "location_id",
            date_key(local_timestamp(orders, "created_at")).alias("day"),
            F.col("customer_lat").cast("double").alias("lat"),
            F.col("customer_lng").cast("double").alias("lng"),
            F.col("net_amount").cast("double").alias("net_amount"),
        )
        .join(locations.select("location_id", "zone"), "location_id", "left")
        .select("order_id", "day", "lat", "lng", "zone", "net_amount")
    )


def sequence_stops(assigned: DataFrame, batch: list[str]) -> DataFrame:
    """One row per stop: its position in the naive and in the optimised route.

    A route's stops are gathered into arrays, which the courier's capacity bounds when
    the fleet grows with demand.
    """
    route = [*batch, "courier"]
    stops = F.sort_array(F.collect_list(F.struct("order_id", "lat", "lng", "zone")))
    planned = (
        assigned.groupBy(*route)
        .agg(stops.alias("stops"))
        .withColumn("plan", plan_route("stops.lat", "stops.lng"))
    )
    return planned.select(
        *route, F.posexplode("stops").alias("pos", "stop"), "plan"
    ).select(
        *route,
        "stop.*",
        F.array_position("plan.naive", F.col("pos") + 1).cast("int").alias("naive_pos"),
        F.array_position("plan.best", F.col("pos") + 1).cast("int").alias("best_pos"),
    )


def _tour_km(stops: str) -> Column:
    """Length of kitchen -> stops in array order -> kitchen."""
    kitchen = F.array(F.struct(F.lit(KITCHEN_LAT).alias("lat"), F.lit(KITCHEN_LNG).alias("lng")))
    points = F.transform(
        stops, lambda s: F.struct(s["lat"].alias("lat"), s["lng"].alias("lng"))
    )
    legs = F.zip_with(
        F.concat(kitchen, points),
        F.concat(points, kitchen),
        lambda p, q: haversine_km(p["lat"], p["lng"], q["lat"], q["lng"]),
    )
    return F.aggregate(legs, F.lit(0.0), lambda total, km: total + km)


def route_report(
    sequenced: DataFrame, batch: list[str], speed_kmh: float = AVG_SPEED_KMH
) -> DataFrame:
    """Per courier: stops, zones, lengths, minutes, 2-opt gain and the sequence."""
    def in_order(position: str):
        return F.sort_array(F.collect_list(F.struct(position, "lat", "lng", "order_id")))

    total, naive = F.col("best_km"), F.col("naive_km")
    return (
        sequenced.groupBy(*batch, "courier")
        .agg(
            F.count("*").cast("int").alias("stops"),
            F.sort_array(F.collect_set("zone")).alias("zones"),
            in_order("best_pos").alias("best"),
            in_order("naive_pos").alias("naive"),
        )
        .withColumns({"best_km": _tour_km("best"), "naive_km": _tour_km("naive")})
        .select(
            *batch,
            F.concat(F.lit("repartidor-"), (F.col("courier") + 1).cast("string")).alias("courier"),
            "stops",
            "zones",
            F.round(total, 2).alias("total_km"),
            F.round(total / F.lit(float(speed_kmh)) * 60, 1).alias("est_minutes"),
            F.round(naive, 2).alias("naive_nn_km"),
            F.when(naive > 0, F.round((naive - total) * 100 / naive, 1))
            .otherwise(F.lit(0.0))
            .alias("improvement_pct"),
            F.col("best.order_id").alias("sequence"),
        )
    )


def plan_deliveries(
    orders: DataFrame,
    locations: DataFrame,
    batch: list[str] | None = None,
    n_couriers: int = 4,
    capacity: int = 10,
    grow_fleet: bool = True,
) -> DataFrame:
    """Stops of every route with their positions.

    Defaults plan each delivery day by itself with as many couriers as it needs, at
    least ``n_couriers``. ``batch=[]`` with ``grow_fleet=False`` is one plan for a fixed
    fleet; routes then grow with the number of orders, so keep that for order sets a
    fixed fleet can really serve.
    """
    batch = ["day"] if batch is None else batch
    assigned = assign_couriers(
        deliverable(orders, locations), batch, "zone", "order_id", n_couriers, capacity, grow_fleet
    )
    return sequence_stops(assigned, batch)


def retime(sequenced: DataFrame, batch: list[str], orders: DataFrame, mesh: DataFrame) -> DataFrame:
    """Minutes of each route by the location mesh instead of straight lines.

    Consecutive stops are looked up as mesh edges (two stops in one location take no
    mesh time); the legs from and to the kitchen are not part of the mesh.
    """
    route = [*batch, "courier"]
    located = sequenced.join(orders.select("order_id", "location_id"), "order_id")
    stops = F.sort_array(F.collect_list(F.struct("best_pos", "location_id")))
    legs = (
        located.groupBy(*route)
        .agg(stops.alias("stops"))
        .select(
            *route,
            F.explode_outer(
                F.arrays_zip(
                    F.slice("stops.location_id", 1, F.size("stops") - 1).alias("src"),
                    F.slice("stops.location_id", 2, F.size("stops")).alias("dst"),
                )
            ).alias("leg"),
        )
        .select(*route, "leg.src", "leg.dst")
    )
    return (
        legs.join(mesh.select("src", "dst", "tenths"), ["src", "dst"], "left")
        .groupBy(*route)
        .agg((F.coalesce(F.sum("tenths"), F.lit(0)) / 10).alias("mesh_minutes"))
    )
