"""Substring joins without a cross join.

``text LIKE '%pattern%'`` is turned into an equality: of each pattern's longest literal run, the run of
``GRAM`` letters that the fewest texts hold is its key; texts are exploded into their own such runs, of
which only those that are a pattern's key go on; the LIKE itself then verifies. So a key that many
texts hold is used only where a pattern has no rarer one. ``_`` and ``%`` in a pattern keep their meaning as
wildcards; nothing escapes them. A pattern whose longest run is shorter is keyed by that run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 5


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` letters of a text."""
    none = F.array().cast("array<string>")
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(none)


def like_join(patterns: DataFrame, pattern: str, texts: DataFrame, text: str, how: str = "inner", gram: int = GRAM) -> DataFrame:
    """Rows of ``patterns`` x ``texts`` where the text contains the pattern, both lower-cased.

    A null or empty pattern contains nothing to look for and joins nothing. ``how`` may be ``inner``,
    ``left_semi`` or ``left_anti`` with respect to ``patterns``.
    """
    runs = F.transform(F.split(F.lower(F.col(pattern)), "[%_]"), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    keyed = patterns.withColumn("_run", F.array_max(runs)["r"])
    distinct = keyed.where("length(_run) > 0").select("_run").distinct()
    # at most ``gram`` of them come to the driver
    sizes = sorted(r.n for r in distinct.select(F.least(F.length("_run"), F.lit(gram)).alias("n")).distinct().collect())
    low = F.lower(F.col(text))
    of_pattern = F.expr("cast(array() as array<string>)")
    for n in sizes:
        of_pattern = F.when(F.least(F.length("_run"), F.lit(gram)) == n, _grams(F.col("_run"), n)).otherwise(of_pattern)
    grams = distinct.select("_run", F.explode(of_pattern).alias("_gram"))
    held = texts.select(low.alias("_low")).distinct().select(F.explode(F.flatten(F.array(*(_grams(F.col("_low"), n) for n in sizes))) if sizes else F.expr("cast(array() as array<string>)")).alias("_gram"))
    counts = held.join(grams.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    keys = grams.join(counts, "_gram", "left").groupBy("_run").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram"))["_gram"].alias("_key"))
    exploded = texts.withColumn("_key2", F.explode(F.flatten(F.array(*(_grams(low, n) for n in sizes))) if sizes else F.expr("cast(array() as array<string>)")))
    exploded = exploded.join(keys.select(F.col("_key").alias("_key2")).distinct(), "_key2", "left_semi")
    hit = (F.col("_key") == F.col("_key2")) & F.like(F.lower(F.col(text)), F.concat(F.lit("%"), F.lower(F.col(pattern)), F.lit("%")), F.lit("\u0001"))
    left = keyed.join(keys, "_run", "left")
    if how == "inner":
        return left.where("_key is not null").join(exploded, hit).drop("_run", "_key", "_key2")
    return left.join(exploded, hit, how).drop("_run", "_key")
