"""Queries of the training-data operators over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataclaim.llm import canonical, formatting, leakage, lines, nearduplicates, pairs, residue, splitting, tokens
from strataclaim.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "training_examples"), "id", "query", "response")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs_, members = nearduplicates.near_duplicates(table(spark, d, "chunks"), "chunk_id", ("paper_title", "text"), shingle=3, threshold=0.5, measure="jaccard")
    return nearduplicates.all_pairs(pairs_, members).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p3_mapped(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, tab).select(F.lit(tab).alias("tab"), F.col("id").alias("row_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("tab", "row_id", "x.field", "x.value")
        for tab, fields in (("observations", ("subject", "object")), ("causal_relations", ("source_concept", "target_concept")))
    ]
    return canonical.map_values(parts[0].unionByName(parts[1]), table(spark, d, "concept_cells"), "id", "canonical_name", "aliases", "evidence_count")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_mapped(spark, d).select("tab", "row_id", "field", "concept_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        splitting.split_items(table(spark, d, name), key, "text").withColumn("tab", F.lit(name))
        for name, key in (("chunks", "chunk_id"), ("private_papers", "id"))
    ]
    return parts[0].unionByName(parts[1]).select("tab", "row_id", "piece_no", "n_pieces", "start", "body_start", "end", "piece")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        splitting.split_items(table(spark, d, name), key, "text", keep_short=False).where("piece_no = 1 and n_pieces > 1").select(F.lit(name).alias("tab"), F.col("row_id").cast("long"))
        for name, key in (("chunks", "chunk_id"), ("private_papers", "id"))
    ]
    return parts[0].unionByName(parts[1])


def _copies(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    relations = formatting.pair_key("source_concept", "relation_type", "target_concept", "conditions")
    return {
        "causal_relations": formatting.copies(table(spark, d, "causal_relations"), "id", relations),
        "beliefs": formatting.copies(table(spark, d, "beliefs"), "id", formatting.fields_key("belief_text")),
    }


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (members.select(F.lit(name).alias("tab"), "keep_id", "dup_id") for name, (_, members) in _copies(spark, d).items())
    return a.unionByName(b)


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    a, b = (records.select(F.lit(name).alias("tab"), "keep_id", "n_copies") for name, (records, _) in _copies(spark, d).items())
    return a.unionByName(b)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "chunks"), "chunk_id", "source", "text")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return lines.remove_lines(table(spark, d, "chunks"), "chunk_id", "source", "text")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode_corpus(p7_ids(spark, d), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return found.where(F.col("run") >= leakage.MIN_RUN).select("doc_id", "item_id")


def p8_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_evidence(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"), "doc_id", "source", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_evidence(spark, d).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_mapped, p4_found, p4_pieces, p5_found, p5_records, p6_found, p6_cleaned, p7_ids, p7_decoded, p8_found, p8_overlaps, p9_found, p9_evidence)}


def oracle_sql() -> dict[str, str]:
    from strataclaim.llm import sql

    return dict(sql.SQL)
