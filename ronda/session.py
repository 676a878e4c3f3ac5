"""Session configuration the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# All of these are runtime SQL settings, so they also apply to a session that
# a cluster hands over.  Skewed joins are split even where that costs one more
# shuffle: a hot site must not end up in a single task.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def prepare(spark: SparkSession) -> SparkSession:
    """Applies the settings to a session.

    Shuffles start with at least two partitions per core unless a number was
    chosen; adaptive execution puts small ones together again.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if spark.conf.get(INITIAL_PARTITIONS, None) is None:
        chosen = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set(INITIAL_PARTITIONS, str(max(chosen, 2 * cores)))
    return spark


def local_session(app: str, cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
