"""A session with the settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "kindred", master: str | None = None, **more: str) -> SparkSession:
    """Adaptive execution, UTC, and settings given by name (dots as two underscores). On a cluster, leave ``master`` out."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("KINDRED_MEMORY", "6g")).config("spark.sql.shuffle.partitions", "8")
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
