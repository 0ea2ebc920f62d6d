"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession


# Generated methods over this many bytes are never compiled by HotSpot, only interpreted.
# Above it, Spark then runs operator by operator, in methods that are compiled: for the wide
# feature projections that is several times faster.
RUNTIME = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Settings that can be changed on a running session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "flowloom", master: str | None = None, **conf) -> SparkSession:
    """Adaptive execution on, UTC, and skew handling for joins on hot keys."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()
