"""Adapter: map the TPC-H-like Parquet tables to the seven logical source tables.

Money is DECIMAL from the first step, coordinates use a few IEEE operations and
distances are rounded to metres, so another engine computes the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogon.functions.geo import km_from_kitchen
from fogon.functions.money import integer_div

# Market segments in alphabetical order; the position is part of the
# location id (5 per nation).
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


# Column types of the tables read here.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


class TpchSources:
    """The logical source tables as lazy DataFrames over one test-data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def read(self, logical: str) -> DataFrame:
        return getattr(self, logical)()

    @staticmethod
    def _location_id():
        segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment"))
        return (F.col("c_nationkey") * 5 + segment - 1).cast("int")

    @staticmethod
    def _latitude(location_id):
        return F.lit(9.80) + F.pmod(location_id * 37, F.lit(125)) / F.lit(500.0)

    @staticmethod
    def _longitude(location_id):
        return F.lit(-84.40) + F.pmod(location_id * 53, F.lit(125)) / F.lit(250.0)

    def locations(self, seen: bool = True) -> DataFrame:
        """The (nation, segment) places: those that have a customer, or all of them.

        All of them are 5 per nation row, so their size follows from the small nation
        table and Spark broadcasts them by its own size check: the form for look-ups
        from large facts, where a place without customers never matches.
        """
        if seen:
            places = self.table("customer").select("c_nationkey", "c_mktsegment").distinct()
        else:
            segment = F.explode(F.array(*[F.lit(s) for s in SEGMENTS]))
            places = self.table("nation").select(
                F.col("n_nationkey").alias("c_nationkey"), segment.alias("c_mktsegment")
            )
        loc = F.col("location_id")
        return (
            places.join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                self._location_id().alias("location_id"),
                F.col("r_name").alias("province"),
                F.col("n_name").alias("canton"),
                F.concat_ws("/", "n_name", "c_mktsegment").alias("district"),
                F.concat(
                    F.lit("Z"), F.pmod("n_nationkey", F.lit(4)).cast("string")
                ).alias("zone"),
            )
            .withColumns({"latitude": self._latitude(loc), "longitude": self._longitude(loc)})
        )

    def categories(self) -> DataFrame:
        """Categories by name; the id is a fixed function of the name."""
        return (
            self.table("part").select(F.col("p_type").alias("name")).distinct()
            .select(F.concat(F.lit("cat-"), F.hex(F.crc32("name"))).alias("category_id"), "name")
        )

    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
            F.lit(True).alias("is_active"),
        )

    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        jitter = (F.pmod(key * 13, F.lit(41)) - 20) / F.lit(1000.0)
        loc = F.col("location_id")
        return (
            self.table("customer")
            .withColumn("location_id", self._location_id())
            .select(
                key.alias("user_id"),
                F.col("c_name").alias("full_name"),
                F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
                F.date_add(
                    F.lit("1994-01-01").cast("date"), F.pmod(key, F.lit(365)).cast("int")
                ).alias("signup_date"),
                loc,
                F.when(
                    (key > 0) & (F.pmod(key, F.lit(20)) < 7), integer_div(key, F.lit(2))
                ).alias("referred_by"),
                (self._latitude(loc) + jitter).alias("latitude"),
                (self._longitude(loc) + jitter).alias("longitude"),
            )
        )

    def orders(self, customer: bool = True, line_count: bool = True) -> DataFrame:
        """Order headers.

        The header table lacks the customer's location and the number of lines. Both are
        joins on large keys, so a caller that needs neither leaves them (and their
        columns) out.
        """
        key = F.col("o_orderkey")
        hours = F.make_dt_interval(hours=(F.pmod(key * 7, F.lit(16)) + 7).cast("int"))
        status = (
            F.when(
                F.col("o_orderstatus") == "P",
                F.when(F.pmod(key, F.lit(3)) == 0, "cancelled").otherwise("completed"),
            )
            .when(F.col("o_orderstatus") == "F", "delivered")
            .when(F.pmod(key, F.lit(2)) == 0, "pending")
            .otherwise("preparing")
        )
        gross = F.col("o_totalprice").cast("decimal(14,2)")
        tenth = F.round(gross * F.lit("0.10").cast("decimal(2,2)"), 2)
        discount = F.when(F.pmod(key, F.lit(100)) < 18, tenth).otherwise(F.lit(0))
        headers = self.table("orders").select(
            key.alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            (F.col("o_orderdate") + hours).alias("created_at"),
            status.alias("status"),
            gross.alias("gross_amount"),
            discount.cast("decimal(14,2)").alias("discount_amount"),
            (gross - discount).cast("decimal(14,2)").alias("net_amount"),
        )
        if customer:
            users = self.users().select(
                "user_id",
                "location_id",
                F.col("latitude").alias("customer_lat"),
                F.col("longitude").alias("customer_lng"),
            )
            km = km_from_kitchen(F.col("customer_lat"), F.col("customer_lng"))
            headers = headers.join(users, "user_id", "left").withColumn(
                "delivery_km", F.round(km, 3)
            )
        if line_count:
            lines = (
                self.table("lineitem")
                .groupBy(F.col("l_orderkey").alias("order_id"))
                .agg(F.count("*").cast("int").alias("item_count"))
            )
            headers = headers.join(lines.hint("merge"), "order_id", "left").withColumn(
                "item_count", F.coalesce("item_count", F.lit(0))
            )
        return headers

    # Order numbers and line numbers repeat, the full row does not, so the whole
    # typed row is the line's natural id.
    LINE_ID = (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )

    def order_items(self) -> DataFrame:
        amount = F.col("l_extendedprice").cast("decimal(14,2)")
        quantity = F.col("l_quantity").cast("int")
        return self.table("lineitem").select(
            F.struct(*self.LINE_ID).alias("order_item_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            quantity.alias("quantity"),
            F.round(amount / F.nullif(quantity, F.lit(0)), 2)
            .cast("decimal(12,2)")
            .alias("unit_price"),
            amount.alias("line_amount"),
        )

    def reservations(self) -> DataFrame:
        status = (
            F.when(F.col("event_type") == "purchase", "honored")
            .when(F.col("event_type") == "error", "no_show")
            .when(F.col("event_type") == "click", "cancelled")
        )
        events = self.table("events").where(F.col("event_type").isin("purchase", "error", "click"))
        users = self.users().select(F.col("user_id").alias("u_id"), "location_id")
        return events.join(users, F.col("user_id") == F.col("u_id"), "left").select(
            F.col("event_id").alias("reservation_id"),
            "user_id",
            "location_id",
            F.col("ts").alias("reserved_at"),
            (F.pmod("event_id", F.lit(8)) + 1).cast("int").alias("party_size"),
            status.alias("status"),
        )
