"""Session factory and the runtime settings every job relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime-settable SQL options. forceOptimizeSkewedJoin lets AQE split a hot join
# key even when the stage above wants the join's partitioning (it then adds one
# shuffle, only for a join that really is skewed). Shuffles start wide and are coalesced
# to the advisory size, and files are read in pieces of that size (a packed table has ten million rows in the
# 128 MB of Spark's default), so what a task sorts or hashes does not grow with the input. Written tables are
# packed with zstd: a load writes its lines several times.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.parquet.compression.codec": "zstd",
}

DEFAULT_TIME_ZONE = "America/Costa_Rica"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime options to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_spark(
    app_name: str = "fogon",
    time_zone: str | None = None,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    jdbc_package: str | None = None,
    hive_metastore_uri: str | None = None,
    warehouse_dir: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build a session: time zone, shuffle width, optional JDBC driver, optional Hive catalog.

    ``shuffle_partitions`` stays unset on a cluster unless asked for, so the
    cluster's own value (with AQE coalescing below it) decides. A session that already runs
    keeps its time zone unless one is named; a new one gets ``DEFAULT_TIME_ZONE``.
    """
    builder = SparkSession.builder.appName(app_name)
    if time_zone or SparkSession.getActiveSession() is None:
        builder = builder.config("spark.sql.session.timeZone", time_zone or DEFAULT_TIME_ZONE)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if jdbc_package:
        builder = builder.config("spark.jars.packages", jdbc_package)
    if warehouse_dir:
        builder = builder.config("spark.sql.warehouse.dir", warehouse_dir)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    if hive_metastore_uri:
        builder = builder.config("hive.metastore.uris", hive_metastore_uri).enableHiveSupport()
    return tune(builder.getOrCreate())
