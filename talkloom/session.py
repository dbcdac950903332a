"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC keeps timestamps comparable between engines. AQE coalesces small shuffle
# partitions, picks broadcast joins from measured sizes and splits skewed join
# partitions, also where the split costs one more shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "talkloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
