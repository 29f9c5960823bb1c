"""Writers: vectors by namespace, reports, append-only logs, upserts by key, a cache with a lifetime."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vectors(df: DataFrame, path: str, namespace: str, text_cols: tuple[str, ...] = ("text", "paper_title"), limits: tuple[int, ...] = (500, 300)) -> None:
    """Vectors with their metadata cut to a length, partitioned by namespace; other namespaces stay."""
    for c, n in zip(text_cols, limits):
        if c in df.columns:
            df = df.withColumn(c, F.left(c, F.lit(n)))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(namespace).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines."""
    df.write.mode("append").json(path)


def upsert(target: DataFrame | None, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Target and new rows with the newest row of each key; one shuffle with map-side combination."""
    both = new if target is None else target.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    last = both.groupBy(*key).agg(F.max(F.struct(*order, F.struct(*rest).alias("_row"))).alias("m"))
    return last.select(*key, *(F.col(f"m._row.{c}").alias(c) for c in rest))


def insert_new(target: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows whose key the target doesn't hold, one of each key."""
    fresh = new.dropDuplicates(key)
    return fresh if target is None else fresh.join(target.select(*key), key, "left_anti")


def replace_pending(target: DataFrame, new: DataFrame, status: str = "status") -> DataFrame:
    """Settled rows of the target, and the new ones in place of those pending."""
    return target.where(F.col(status) != "pending").unionByName(new, allowMissingColumns=True)


def slug(c: F.Column) -> F.Column:
    """A file name from a title: letters and digits, joined by dashes, 60 characters at most."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"(^-+|-+$)", ""), F.lit(60))


def report_markdown(df: DataFrame) -> DataFrame:
    """Reports (title, verdict, confidence, findings ARRAY) as Markdown texts under their slugs."""
    items = F.array_join(F.transform("findings", lambda f: F.concat(F.lit("- "), f)), "\n")
    text = F.concat(F.lit("# "), F.col("title"), F.lit("\n\nVerdict: "), F.col("verdict"), F.lit(" ("), F.format_number("confidence", 2), F.lit(")\n\n"), items, F.lit("\n"))
    return df.select(slug(F.col("title")).alias("slug"), text.alias("markdown"))


def cached(spark: SparkSession, path: str, now, ttl_seconds: int = 3600) -> DataFrame:
    """Rows of a result cache that are not older than their lifetime at ``now``."""
    df = spark.read.parquet(path)
    return df.where(F.col("cached_at") > F.lit(now) - F.expr(f"interval {ttl_seconds} seconds"))
