"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A deep result page needs 5001 candidates; keep per-query top-k cuts map-side up to there.
    "spark.sql.optimizer.windowGroupLimitThreshold": "8192",
    # Composite searches hold more generated classes than the default cache; evicting them
    # makes every task compile its code again.
    "spark.sql.codegen.cache.maxEntries": "4096",
    "spark.ui.enabled": "false",
}


def build_session(
    app_name: str = "quarrylamp",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or fetch) a session; `master` is left to spark-submit when omitted."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
