"""Problem 5: records that differ only in formatting or field order, collapsed and counted.

Two values are the same if they are equal once letter case and every character that is neither
letter nor digit are ignored. A record's canonical form is hashed to 16 bytes; only the hash and the
id travel. Hot keys are found exactly from partial counts (one map-side combined aggregation) and are
salted into a two-level aggregation, the rest takes one level; the representative is the smallest id.

A null field counts as blank. An empty or blank record is a record like any other (its copies are the
other blank ones). Repeated rows under one id count as copies, but a representative is never its own
duplicate. Ties can't occur: ids order copies. Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataclaim.session import write_cut

#: Relations whose two concepts may stand in either order, in canonical form.
SYMMETRIC = ("analogousto", "contradicts", "sharesmechanism")
#: Names of the fields a belief's record may have.
BELIEF_FIELDS = ("subject", "predicate", "object", "conditions", "magnitude")
#: At most this many keys can be hot: a hot key has more than a ``HOT_SHARE``-th of all rows.
HOT_SHARE = 1_000
SALTS = 64


def canonical(c: Column | str) -> Column:
    """Letters and digits only, lower-cased; a null becomes an empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def pair_key(a: str, relation: str, b: str, *rest: str, symmetric: tuple[str, ...] = SYMMETRIC) -> Column:
    """Canonical form of a relation between two values; symmetric ones ignore the order."""
    x, y, r = canonical(a), canonical(b), canonical(relation)
    swap = r.isin(*symmetric) & (x > y)
    return F.concat_ws("\u0001", F.when(swap, y).otherwise(x), r, F.when(swap, x).otherwise(y), *(canonical(c) for c in rest))


def fields_key(text: str, names: tuple[str, ...] = BELIEF_FIELDS) -> Column:
    """Canonical form of a sentence, or of named fields in any order and notation.

    A text is a record of fields if it begins (but for marks) with a field's name followed by a colon
    or an equals sign and names two fields or more; it then is the sorted set of its named values.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    name = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(names) + r")(?=[^\p{L}\p{N}:=]*[:=])"
    parts = F.split(F.regexp_replace(t, name, "\u0001$1\u0002"), "\u0001")
    values = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(canonical(F.substring_index(p, "\u0002", 1)), F.lit("\u0002"), canonical(F.substring_index(p, "\u0002", -1))))
    is_record = (F.size(parts) >= 3) & (canonical(F.get(parts, F.lit(0))) == "")
    return F.when(is_record, F.array_join(F.array_sort(F.array_distinct(values)), "\u0001")).otherwise(canonical(t))


def copies(df: DataFrame, id_col: str, key: Column, hot_share: int = HOT_SHARE, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """``(records, membership)`` of ``df``.

    ``records`` has ``(keep_id, n_copies)``, one row a distinct record; ``membership`` has
    ``(keep_id, dup_id)``, one row for each copy but the kept one.
    """
    rows = write_cut(df.select(F.col(id_col).alias("id"), F.unhex(F.md5(key)).alias("k")))
    counts = rows.groupBy("k").count()
    total = rows.count()
    # fewer than hot_share keys can have more than total / hot_share rows, so this side is bounded
    hot = F.broadcast(write_cut(counts.where(F.col("count") > F.lit(max(1000, total // hot_share))).select("k")))
    plain = rows.join(hot, "k", "left_anti")
    salted = rows.join(hot, "k", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    one = plain.groupBy("k").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    two = (
        salted.groupBy("k", "salt").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
        .groupBy("k").agg(F.min("keep_id").alias("keep_id"), F.sum("n_copies").alias("n_copies"))
    )
    records = one.unionByName(two).select("keep_id", "n_copies")
    kept_hot = F.broadcast(two.select("k", "keep_id"))
    dups_hot = salted.join(kept_hot, "k").where("id <> keep_id")
    dups = plain.join(one.where("n_copies > 1").select("k", "keep_id"), "k").where("id <> keep_id")
    membership = dups.select("keep_id", F.col("id").alias("dup_id")).unionByName(dups_hot.select("keep_id", F.col("id").alias("dup_id")))
    return records, membership
