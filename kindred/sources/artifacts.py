"""Small artifacts: seed lists in several shapes, JSON tables, and a report page with its data inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(slug, pos) from files that hold a JSON object with ``seeds``, a JSON list of slugs or of objects with ``slug``, or
    lines of text (blank lines and # comments are skipped). Repeats keep their first place; places may have gaps."""
    whole = spark.read.text(path, wholetext=True).select("value", F.when(F.col("value").rlike(r"^\s*[\[{]"), F.try_parse_json("value")).alias("_v"))
    text = lambda x, at: F.try_variant_get(x, at, "string")
    listed = whole.where("_v is not null").select(F.coalesce(F.try_variant_get("_v", "$.seeds", "variant"), F.col("_v")).alias("_list"))
    parsed = listed.lateralJoin(spark.tvf.variant_explode(F.col("_list").outer()))
    parsed = parsed.where("key is null").select(F.coalesce(text(F.col("value"), "$.slug"), F.when(F.schema_of_variant("value").isin("STRING", "BIGINT"), text(F.col("value"), "$"))).alias("slug"), "pos")
    lines = whole.where("_v is null").select(F.posexplode(F.split("value", "\n")).alias("pos", "_line")).select(F.trim(F.regexp_replace("_line", "\r$", "")).alias("slug"), "pos")
    found = parsed.unionByName(lines.where(~F.startswith("slug", F.lit("#"))))
    return found.where(F.col("slug") != "").groupBy("slug").agg(F.min("pos").alias("pos"))


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def read_json(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def read_variants(spark: SparkSession, folder: str, column: str = "v") -> DataFrame:
    """One JSON value a line, of whatever shape; lines that aren't JSON are null."""
    return spark.read.text(folder).select(F.try_parse_json("value").alias(column))


def histograms(artifacts: DataFrame, column: str = "v") -> DataFrame:
    """(film, stars, n) of artifacts that name a film as ``slug`` or ``film`` and its ratings as ``hist``: an object of
    levels, a list of [level, count], or a list of objects with ``stars`` and ``n``. Other values have no rows."""
    v = F.col(column)
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    rows = artifacts.select(F.coalesce(get(v, "$.slug", "string"), get(v, "$.film", "string")).alias("film"), get(v, "$.hist", "variant").alias("_hist"))
    rows = rows.where("film is not null and _hist is not null")
    each = rows.lateralJoin(artifacts.sparkSession.tvf.variant_explode(F.col("_hist").outer()))
    value = F.col("value")
    stars = F.coalesce(F.col("key").try_cast("double"), get(value, "$.stars", "double"), get(value, "$[0]", "double"))
    n = F.coalesce(F.when(F.col("key").isNotNull(), get(value, "$", "bigint")), get(value, "$.n", "bigint"), get(value, "$[1]", "bigint"))
    return each.select("film", stars.alias("stars"), n.alias("n")).where("stars is not null and n is not null")


def report(rows: DataFrame, template: str, placeholder: str, limit: int) -> str:
    """A page with the first ``limit`` rows as compact JSON in place of ``placeholder``; rows must be ordered."""
    payload = [r[0] for r in rows.limit(limit).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    return template.replace(placeholder, "[" + ",".join(payload).replace("</", "<\\/") + "]")


def probe_verdict(status: str = "status", transport: str = "transport", cached: str = "from_cache"):
    """What a stored probe of an address shows."""
    ok = F.col(status).between(200, 299)
    return F.when(F.col(cached), "?").when(ok & (F.col(transport) == "browser"), "browser").when(ok, "http").otherwise("BLOCKED")
