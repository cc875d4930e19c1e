"""Property graph as node and edge DataFrames, and the queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogon.functions.geo import AVG_SPEED_KMH, haversine_km, travel_minutes_tenths
from fogon.operators.cooccurrence import top_pairs
from fogon.operators.pagerank import pagerank
from fogon.operators.paths import cheapest_paths
from fogon.operators.reach import descendant_counts

# ---- nodes and edges -----------------------------------------------------------


def _one_per_id(rows: DataFrame, key: str) -> DataFrame:
    """One row per id. Of rows that repeat an id the largest by its columns, in their
    order, is kept, so a node does not depend on how the input is cut."""
    rest = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("kept")).select(key, *[f"kept.{c}" for c in rest])
    )


def location_nodes(locations: DataFrame) -> DataFrame:
    return _one_per_id(
        locations.select(
            "location_id", "province", "canton", "district", "zone",
            F.col("latitude").alias("lat"), F.col("longitude").alias("lng"),
        ),
        "location_id",
    )


def product_nodes(products: DataFrame) -> DataFrame:
    return _one_per_id(
        products.select("product_id", "name", "category", F.col("price").cast("double").alias("price")),
        "product_id",
    )


def user_nodes(users: DataFrame) -> DataFrame:
    return _one_per_id(
        users.select(
            "user_id", F.col("full_name").alias("name"),
            F.col("latitude").cast("double").alias("lat"),
            F.col("longitude").cast("double").alias("lng"),
        ),
        "user_id",
    )


def order_nodes(orders: DataFrame) -> DataFrame:
    return _one_per_id(
        orders.select(
            "order_id", "created_at", "status",
            F.col("net_amount").cast("double").alias("net_amount"),
            F.col("delivery_km").cast("double").alias("delivery_km"),
        ),
        "order_id",
    )


def nodes(locations, products, users, orders) -> dict[str, DataFrame]:
    return {
        "Location": location_nodes(locations),
        "Product": product_nodes(products),
        "User": user_nodes(users),
        "Order": order_nodes(orders),
    }


def node_table(locations, products, users, orders) -> DataFrame:
    """All nodes as (label, node_id, name)."""
    parts = (
        ("Location", location_nodes(locations), "location_id", "district"),
        ("Product", product_nodes(products), "product_id", "name"),
        ("User", user_nodes(users), "user_id", "name"),
        ("Order", order_nodes(orders), "order_id", "status"),
    )
    out = None
    for label, df, key, name in parts:
        rows = df.select(
            F.lit(label).alias("label"),
            F.col(key).cast("string").alias("node_id"),
            F.col(name).alias("name"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def node_counts(locations, products, users, orders) -> DataFrame:
    return (
        node_table(locations, products, users, orders)
        .groupBy("label")
        .agg(F.count("*").alias("n_nodes"))
    )


def lives_in(users: DataFrame, locations: DataFrame) -> DataFrame:
    """(user_id, location_id); a user without a known location has no edge."""
    return (
        users.select("user_id", "location_id")
        .distinct()
        .join(locations.select("location_id"), "location_id", "left_semi")
        .select("user_id", "location_id")
    )


def placed(orders: DataFrame, users: DataFrame) -> DataFrame:
    return (
        orders.select("user_id", "order_id")
        .distinct()
        .join(users.select("user_id"), "user_id", "left_semi")
    )


def recommended(users: DataFrame) -> DataFrame:
    """(src, dst): referrer -> referred; blank or unknown referrers have no edge."""
    named = users.where(
        F.col("referred_by").isNotNull() & (F.col("referred_by").cast("string") != "")
    )
    links = named.select(F.col("referred_by").alias("src"), F.col("user_id").alias("dst"))
    known = users.select(F.col("user_id").alias("src"))
    return links.distinct().join(known, "src", "left_semi").select("src", "dst")


def contains(order_items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """(order_id, product_id, quantity): one edge per pair, the last line's quantity."""
    return (
        order_items.groupBy("order_id", "product_id")
        .agg(F.max_by(F.col("quantity").cast("bigint"), "order_item_id").alias("quantity"))
        .join(orders.select("order_id"), "order_id", "left_semi")
        .join(products.select("product_id"), "product_id", "left_semi")
        .select("order_id", "product_id", "quantity")
    )


def route_mesh(
    locations: DataFrame, speed_kmh: float = AVG_SPEED_KMH, blocks: int = 8
) -> DataFrame:
    """Both directions between every two locations: metres and tenths of a minute.

    The mesh is complete by definition, so its size is quadratic in the number of
    locations. The pairing is an equi-join on a pair of block numbers: each location
    is sent to ``blocks`` cells, the blocks^2 cells are independent tasks, and each
    unordered pair meets in one cell.
    """
    block = F.pmod(F.hash("location_id"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    point = locations.select("location_id", "latitude", "longitude")
    left = point.select(
        F.col("location_id").alias("a"), F.col("latitude").alias("lat1"),
        F.col("longitude").alias("lng1"), block.alias("row"), every.alias("col"),
    )
    right = point.select(
        F.col("location_id").alias("b"), F.col("latitude").alias("lat2"),
        F.col("longitude").alias("lng2"), block.alias("col"), every.alias("row"),
    )
    km = F.round(
        haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")), 3
    )
    pairs = (
        left.join(right, ["row", "col"])
        .where("a < b")
        .select("a", "b", km.alias("distance_km"))
        .select(
            "a", "b", "distance_km",
            travel_minutes_tenths(F.col("distance_km"), speed_kmh).alias("tenths"),
        )
    )
    ends = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    )
    return pairs.select(F.explode(ends).alias("e"), "distance_km", "tenths").select(
        "e.src",
        "e.dst",
        "distance_km",
        (F.col("tenths") / 10).alias("minutes"),
        F.round(F.col("distance_km") * 1000).cast("bigint").alias("metres"),
        "tenths",
    )


# ---- co-purchase -----------------------------------------------------------------


def copurchase_top_pairs(order_items: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    """Product pairs by the number of orders that contain both (all statuses)."""
    pairs = top_pairs(order_items, "order_id", "product_id", k)
    a = products.select(F.col("product_id").alias("a"), F.col("name").alias("product_a"))
    b = products.select(F.col("product_id").alias("b"), F.col("name").alias("product_b"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .select(
            F.col("a").alias("product_id_a"), "product_a",
            F.col("b").alias("product_id_b"), "product_b",
            F.col("n").alias("times_together"),
        )
        .orderBy(F.desc("times_together"), "product_id_a", "product_id_b")
    )


def also_bought(
    order_items: DataFrame, products: DataFrame, seed: str, k: int = 5
) -> DataFrame:
    """Companions of the product(s) named ``seed`` by distinct shared orders.

    Several products can carry the seed name. Any other product counts an order that
    holds a seed; a seed itself counts an order that holds another seed as well.
    """
    lines = order_items.select("order_id", "product_id")
    seeds = products.where(F.col("name") == seed).select("product_id")
    seed_orders = (
        lines.join(seeds, "product_id", "left_semi")
        .distinct()
        .groupBy("order_id")
        .agg(F.count("*").alias("n_seeds"))
    )
    # Only the lines of orders with a seed are made distinct.
    basket = lines.join(seed_orders.select("order_id"), "order_id", "left_semi").distinct()
    other = products.select(
        "product_id", F.col("name").alias("recommended"), "category",
        (F.col("name") == seed).alias("is_seed"),
    )
    return (
        basket.join(seed_orders, "order_id")
        .groupBy("product_id")
        .agg(
            F.count("*").alias("any_seed"),
            F.count_if(F.col("n_seeds") > 1).alias("other_seed"),
        )
        .join(other, "product_id")
        .select(
            "product_id", "recommended", "category",
            F.when(F.col("is_seed"), F.col("other_seed"))
            .otherwise(F.col("any_seed")).alias("support"),
        )
        .where("support > 0")
        .orderBy(F.desc("support"), "product_id")
        .limit(k)
    )


def category_affinity(order_items: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """Category pairs by the number of baskets that contain both."""
    rows = order_items.join(products.select("product_id", "category"), "product_id")
    return top_pairs(rows, "order_id", "category", k, fold=True).select(
        F.col("a").alias("cat_a"), F.col("b").alias("cat_b"), F.col("n").alias("baskets")
    )


# ---- referrals -------------------------------------------------------------------


def _with_names(scores: DataFrame, users: DataFrame) -> DataFrame:
    return scores.join(users.select("user_id", F.col("full_name").alias("name")), "user_id")


def referrers_direct(users: DataFrame, k: int = 10) -> DataFrame:
    top = (
        recommended(users)
        .groupBy(F.col("src").alias("user_id"))
        .agg(F.count("*").alias("direct_referrals"))
        .orderBy(F.desc("direct_referrals"), "user_id")
        .limit(k)
    )
    return (
        _with_names(top, users)
        .select("user_id", "name", "direct_referrals")
        .orderBy(F.desc("direct_referrals"), "user_id")
    )


def referral_reach(users: DataFrame, k: int = 10) -> DataFrame:
    """Users by how many others their referral chains reach at any depth."""
    edges = recommended(users).select(
        F.col("dst").alias("child"), F.col("src").alias("parent")
    )
    top = (
        descendant_counts(edges)
        .select(F.col("v").alias("user_id"), "network_size")
        .orderBy(F.desc("network_size"), "user_id")
        .limit(k)
    )
    return (
        _with_names(top, users)
        .select("user_id", "name", "network_size")
        .orderBy(F.desc("network_size"), "user_id")
    )


def referral_pagerank(users: DataFrame, k: int = 10, damping: float = 0.85) -> DataFrame:
    """PageRank along referrer -> referred edges, rounded to 4 decimals.

    Users nobody referred all hold the base rank, which no ranked user undercuts.
    """
    received = pagerank(recommended(users), damping=damping).select(
        F.col("id").alias("user_id"), "rank"
    )
    everyone = users.select("user_id", F.col("full_name").alias("name")).join(
        received, "user_id", "left"
    )
    return (
        everyone.select(
            "user_id",
            "name",
            F.round(F.coalesce("rank", F.lit(1.0 - damping)), 4).alias("pagerank"),
        )
        .orderBy(F.desc("pagerank"), "user_id")
        .limit(k)
    )


# ---- routes ----------------------------------------------------------------------


def _edges(mesh: DataFrame, cost: str) -> DataFrame:
    return mesh.select("src", "dst", F.col(cost).alias("cost"))


def _district_route(paths: DataFrame, locations: DataFrame) -> DataFrame:
    """Replace the location ids of each path by districts, keeping the order."""
    names = locations.select(F.col("location_id").alias("stop"), "district")
    return (
        paths.select("node", "cost", "hops", F.posexplode("path").alias("pos", "stop"))
        .join(names, "stop")
        .groupBy("node", "cost", "hops")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "district"))).alias("stops"))
        .select("node", "cost", "hops", F.col("stops.district").alias("route"))
    )


def route_shortest_path(mesh: DataFrame, locations: DataFrame, source, target) -> DataFrame:
    """Fewest minutes between two locations: districts on the way and total minutes."""
    best = cheapest_paths(_edges(mesh, "tenths"), source, target=target).where(
        F.col("node") == target
    )
    return _district_route(best, locations).select(
        "route", (F.col("cost") / 10).alias("total_minutes")
    )


def route_eta_from_source(mesh: DataFrame, locations: DataFrame, source) -> DataFrame:
    """Minutes from the kitchen's location to every location (itself at 0)."""
    costs = cheapest_paths(_edges(mesh, "tenths"), source, keep_path=False)
    return (
        costs.join(locations, F.col("node") == F.col("location_id"))
        .select("location_id", "district", "zone", (F.col("cost") / 10).alias("eta_minutes"))
        .orderBy("eta_minutes", "location_id")
    )


def route_bounded_path(
    mesh: DataFrame, locations: DataFrame, source, target, max_hops: int = 4
) -> DataFrame:
    """Fewest kilometres over at most ``max_hops`` edges.

    Weights are not negative, so between two different locations the best path repeats
    no edge and the relaxation equals listing every path.
    """
    if source == target:
        raise ValueError("source and target must differ")
    best = cheapest_paths(_edges(mesh, "metres"), source, max_hops, target=target).where(
        F.col("node") == target
    )
    hundredths = F.call_function("div", F.col("cost") + 5, F.lit(10))
    return _district_route(best, locations).select(
        "route", (hundredths / 100).alias("total_km")
    )
