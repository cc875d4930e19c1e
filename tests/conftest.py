import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoint')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from fogon.session import tune

    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def sources(spark):
    """Rows of our own for every source table: besides plain ones a user with an unknown
    referrer and no mail, a product nobody bought, text timestamps."""
    frame = spark.createDataFrame
    return {
        "locations": frame(
            [
                ("north", "Alta", "Pino", "Pino-1", "Z1", 10.25, -84.5),
                ("south", "Baja", "Mar", "Mar-3", "Z2", 9.5, -83.75),
            ],
            "location_id string, province string, canton string, district string, zone string, "
            "latitude double, longitude double",
        ),
        "categories": frame([("c1", "Soup"), ("c2", "Tea")], "category_id string, name string"),
        "products": frame(
            [("p1", "Lentil soup", "Soup", 1500, True), ("p2", "Mint tea", "Tea", 700, True),
             ("p3", "Old soup", "Soup", 900, False)],
            "product_id string, name string, category string, price bigint, is_active boolean",
        ),
        "users": frame(
            [
                ("u1", "Uma", "uma@example.test", "2023-05-04", "north", "", 10.25, -84.5),
                ("u2", "Vid", "vid@example.test", "2023-06-30", "south", "u1", 9.5, -83.75),
                ("u3", "Wen", None, "2023-07-01", "south", "nobody", 9.6, -83.8),
            ],
            "user_id string, full_name string, email string, signup_date string, "
            "location_id string, referred_by string, latitude double, longitude double",
        ),
        "orders": frame(
            [
                ("o1", "u1", "north", "2023-08-04 13:10:00", "delivered", 3700.0, 200.0, 3500.0, 2, 2.25, 10.2, -84.4),
                ("o2", "u2", "south", "2023-08-06 22:05:00", "cancelled", 1500.0, 0.0, 1500.0, 1, 8.5, 9.4, -83.7),
            ],
            "order_id string, user_id string, location_id string, created_at string, "
            "status string, gross_amount double, discount_amount double, net_amount double, "
            "item_count bigint, delivery_km double, customer_lat double, customer_lng double",
        ),
        "order_items": frame(
            [("i1", "o1", "p1", 2, 1500, 3000), ("i2", "o1", "p2", 1, 700, 700), ("i3", "o2", "p1", 1, 1500, 1500)],
            "order_item_id string, order_id string, product_id string, quantity bigint, "
            "unit_price bigint, line_amount bigint",
        ),
        "reservations": frame(
            [("r1", "u1", "north", "2023-08-09 19:30:00", 3, "honored"),
             ("r2", "u2", "south", "2023-08-10 12:00:00", 5, "no_show")],
            "reservation_id string, user_id string, location_id string, reserved_at string, "
            "party_size bigint, status string",
        ),
    }
