"""The page store: stored pages, their freshness and statistics, paginated scans and lists of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.checkpoints import cut

PAGE = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("body", T.StringType()),
    T.StructField("transport", T.StringType()), T.StructField("fetched_at", T.DoubleType()),
])
#: A failed page is asked for again after so many seconds.
FAILURE_SECONDS = 21_600


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages stored as one JSON object a file (gzip or plain), at any depth; damaged files give no row."""
    pages = spark.read.schema(PAGE).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(folder)
    return pages.where("url is not null")


def write_pages(pages: DataFrame, folder: str) -> None:
    """Append pages by host; ``latest`` of what is read back makes writing again harmless."""
    pages.withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)).write.mode("append").partitionBy("host").parquet(folder)


def latest(pages: DataFrame) -> DataFrame:
    return pages.groupBy("url").agg(F.max_by(F.struct(*[c for c in pages.columns if c != "url"]), "fetched_at").alias("p")).select("url", "p.*")


def store_key(url: str = "url") -> Column:
    """Place of an address in the store: host (_ if it has none), the digest's first two digits, the digest."""
    digest = F.sha2(F.col(url).cast("binary"), 256)
    host = F.coalesce(F.nullif(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1), F.lit("")), F.lit("_"))
    return F.concat_ws("/", host, F.substr(digest, F.lit(1), F.lit(2)), digest)


def usable(now: float) -> Column:
    """Whether a stored page answers a request at time ``now``."""
    return F.col("status").between(200, 299) | (F.lit(now) - F.col("fetched_at") <= FAILURE_SECONDS)


def store_stats(pages: DataFrame) -> DataFrame:
    ok = F.col("status").between(200, 299)
    return pages.agg(F.count("*").alias("entries"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).cast("long").alias("body_bytes"))


def run_ends(pages: DataFrame, entity: str = "entity", page: str = "page", rows: str = "n_rows", cap: int | None = None) -> DataFrame:
    """(entity, stop, why): the page at which a scan of each entity's pages from 1 on ends, which is not read any more, and
    why: ``failed``, ``empty``, ``missing`` (also behind the last page) or ``cap``, by which a history may be cut short.

    The first gap is the least page whose successor isn't there, found by a join on the next number, so that no task
    sorts an entity's pages. Pages that are stored twice count as good if one of them is.
    """
    c, ok = F.col, F.coalesce(F.col("status").between(200, 299), F.lit(False))
    seen = pages.where((c(page) >= 1) & c(entity).isNotNull()).groupBy(c(entity).alias("entity"), c(page).cast("long").alias("page"))
    seen = cut(seen.agg(F.max(ok).alias("ok"), F.max(ok & (c(rows) > 0)).alias("full")))
    follows = seen.select("entity", (c("page") - 1).alias("page"), F.lit(True).alias("_next"))
    gaps = seen.join(follows, ["entity", "page"], "left").where("_next is null").groupBy("entity").agg((F.min("page") + 1).alias("_gap"))
    bad = seen.groupBy("entity").agg(F.min(F.when(~c("ok"), c("page"))).alias("_failed"), F.min(F.when(c("ok") & ~c("full"), c("page"))).alias("_empty"), F.min("page").alias("_first"))
    gap = F.when(c("_first") > 1, 1).otherwise(c("_gap"))
    ends = {"cap": F.lit(None if cap is None else cap + 1).cast("long"), "failed": c("_failed"), "empty": c("_empty"), "missing": gap}
    stop, why = F.least(*ends.values()), None
    for name, at in ends.items():
        why = F.when(at == stop, name) if why is None else why.when(at == stop, name)
    return bad.join(gaps, "entity").select("entity", stop.alias("stop"), why.alias("why"))


def scanned(pages: DataFrame, entity: str = "entity", page: str = "page", rows: str = "n_rows", cap: int | None = None) -> DataFrame:
    """Pages of each entity from 1 up to its first failed, empty or missing one, or the cap; ``truncated`` marks those of
    entities that the cap has ended, whose histories may be longer."""
    ends = run_ends(pages, entity, page, rows, cap).select(F.col("entity").alias("_entity"), "stop", (F.col("why") == "cap").alias("truncated"))
    return pages.join(ends, (F.col(entity) == F.col("_entity")) & (F.col(page) >= 1) & (F.col(page) < F.col("stop"))).drop("_entity", "stop")


def listed(lines: DataFrame, line: str = "value", pos: str = "pos") -> DataFrame:
    """(url, pos): addresses of a list without blanks, comments and repeats, at their first place."""
    url = F.trim(line)
    return lines.select(url.alias("url"), pos).where((url != "") & ~F.startswith(url, F.lit("#"))).groupBy("url").agg(F.min(pos).alias("pos"))


def not_stored(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    return wanted.join(pages.select("url"), "url", "left_anti")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated user, item, rating and epoch seconds."""
    return spark.read.csv(path, sep="\t", schema="user string, item string, rating double, ts bigint")


def with_image_text(files: DataFrame, known: DataFrame) -> DataFrame:
    """Images (path, content) as base64 text, without those whose path is known."""
    return files.select("path", "content").join(known.select("path"), "path", "left_anti").select("path", F.base64("content").alias("image"))
