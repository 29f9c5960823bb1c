"""Queries of model hooks with their stand-ins, dimension checks and SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strataclaim.functions import dimensions, hooks
from strataclaim.operators.retrieval import vector_topk
from strataclaim.plans.catalog import query
from strataclaim.session import table
from strataclaim.sources.readers import graph_edges


@query()
def embedding_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks nearest to the questions of the evaluation items, by hashed word vectors."""
    chunks = table(spark, d, "chunks").select("chunk_id", hooks.embed(F.col("text")).alias("v"))
    items = table(spark, d, "eval_items").where("item_id % 20 = 0").select("item_id", hooks.embed(F.col("question")).alias("v"))
    return vector_topk(chunks, "chunk_id", "v", items, "item_id", "v", 8).select(F.col("query_id").alias("item_id"), F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")


@query()
def claim_polarity(spark: SparkSession, d: str) -> DataFrame:
    """Polarity between beliefs and the relations of their concepts."""
    b = table(spark, d, "beliefs").select("id", "belief_text", F.lower("concept_name").alias("k"))
    r = table(spark, d, "causal_relations").groupBy(F.lower("source_concept").alias("k")).agg(F.max_by(F.concat_ws(" ", "source_concept", "relation_type", "target_concept"), F.struct("confidence", "id")).alias("claim"))
    out = b.join(r, "k").select("id", hooks.polarity(F.col("claim"), F.col("belief_text")).alias("p"))
    return out.select("id", "p.label", "p.confidence")


@F.pandas_udf(StringType())
def _check(s: pd.Series) -> pd.Series:
    return s.map(dimensions.check)


@query("SELECT * FROM (VALUES ('F = m*a', 'consistent'), ('E = m*v^2', 'consistent'), ('E = m*c0', 'mismatch'), ('p = m*v + F*t', 'consistent'), ('x = v*t + a*t^2/2', 'consistent'), ('E = zz', 'dimension_unknown'), ('P = V*I', 'consistent')) AS v(equation, result)")
def dimension_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sides of equations agree in their dimensions."""
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, ("F = m*a", "E = m*v^2", "E = m*c0", "p = m*v + F*t", "x = v*t + a*t^2/2", "E = zz", "P = V*I")))).alias("equation"))
    return rows.select("equation", _check("equation").alias("result"))


@query("""SELECT id, trim(regexp_replace(belief_text, '[\\s\\x0B]+', ' ', 'g'), ' ') AS squeezed, 'clm_' || left(sha1(belief_text), 12) AS sid,
 round(CASE WHEN s + c = 0 THEN 0.5 ELSE least(0.95, 0.3 + 0.65 * (s / (s + c + 0.1)) + least(0.1, 0.002 * (s + c))) END, 6) AS confidence FROM (SELECT id, belief_text, coalesce(supporting_count, 0)::DOUBLE AS s, coalesce(contradicting_count, 0)::DOUBLE AS c FROM beliefs)""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The scalar operators called as SQL functions."""
    hooks.register(spark)
    table(spark, d, "beliefs").createOrReplaceTempView("beliefs_now")
    return spark.sql("SELECT id, squeeze(belief_text) AS squeezed, stable_id(belief_text) AS sid, round(belief_confidence(double(coalesce(supporting_count, 0)), double(coalesce(contradicting_count, 0))), 6) AS confidence FROM beliefs_now")


@query("SELECT DISTINCT trim(lower(source_concept), ' ') AS source, lower(relation_type) AS relation, trim(lower(target_concept), ' ') AS target FROM causal_relations WHERE trim(source_concept, ' ') <> '' AND trim(target_concept, ' ') <> ''")
def graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Edges written as graph text in two layouts and read back."""
    e = table(spark, d, "causal_relations").where((F.trim("source_concept") != "") & (F.trim("target_concept") != "")).select(*(F.lower(c).alias(n) for c, n in (("source_concept", "source"), ("relation_type", "relation"), ("target_concept", "target"))))
    lists = e.groupBy("source").agg(F.to_json(F.collect_list(F.array("source", "relation", "target"))).alias("j")).select("j")
    maps = e.groupBy("source", "relation").agg(F.collect_set("target").alias("ts")).select(F.to_json(F.create_map("source", F.create_map("relation", "ts"))).alias("j"))
    return graph_edges(lists.unionByName(maps), "j")
