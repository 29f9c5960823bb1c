"""Weighted evidence: grounding of claims, verdicts, belief confidence, concept stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataclaim.functions.text import clamp


def belief_confidence(supporting: Column, contradicting: Column, refining: Column | None = None, narrowing: Column | None = None, neutral: Column | None = None) -> Column:
    """Confidence from counts: refining counts as .7 for, narrowing as .3 against; .5 without any."""
    zero = F.lit(0)
    r, w, n = (zero if c is None else c for c in (refining, narrowing, neutral))
    total = supporting + contradicting + r + w + n
    pro, con = supporting + 0.7 * r, contradicting + 0.3 * w
    return F.when(total == 0, 0.5).otherwise(F.least(F.lit(0.95), 0.3 + 0.65 * (pro / (pro + con + 0.1)) + F.least(F.lit(0.1), 0.002 * total)))


def lifecycle(evidence: Column, confidence: Column, contradictions: Column) -> Column:
    """Stage of a concept. A last stage below .3 can't be reached, as .5 is tested before it."""
    return F.when(evidence < 3, "candidate").when((evidence < 6) & (contradictions == 0), "emerging").when((evidence >= 6) & (confidence >= 0.75) & (contradictions == 0), "established").when((contradictions >= 2) | (confidence < 0.5), "contested").otherwise("emerging")


def grounding(evidence: DataFrame) -> DataFrame:
    """Counts, means, diversity, coverage and score of ``(claim_id, title, source, polarity, score)``."""
    sup, con = F.col("polarity") == "support", F.col("polarity") == "contradict"
    known = lambda c: F.when(~F.col(c).isin("unknown", ""), F.col(c))
    g = evidence.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sup).alias("supporting"), F.count_if(con).alias("contradicting"),
        F.coalesce(F.avg(F.when(sup, F.col("score"))), F.lit(0.0)).alias("avg_s"), F.coalesce(F.avg(F.when(con, F.col("score"))), F.lit(0.0)).alias("avg_c"),
        F.count_distinct(known("source")).alias("sources"), F.count_distinct(known("title")).alias("titles"),
    )
    one = F.lit(1.0)
    g = g.withColumns({"diversity": 0.5 * (F.least(one, F.col("sources") / 2.0) + F.least(one, F.col("titles") / 2.0)), "coverage": F.least(one, F.col("n") / 6.0)})
    raw = F.col("avg_s") * F.col("supporting") / F.col("n") - 1.15 * (F.col("avg_c") * F.col("contradicting") / F.col("n")) + 0.20 * F.col("diversity") + 0.25 * F.col("coverage")
    return g.withColumn("score", clamp(raw, 0.0, 1.0))


def verdict(n: Column, supporting: Column, contradicting: Column, avg_s: Column, avg_c: Column, score: Column) -> tuple[Column, Column]:
    """Verdict of a grounded claim, and its confidence."""
    lead = supporting - contradicting
    is_sup = (n > 0) & (lead >= 2) & (score >= 0.55) & (avg_s >= avg_c)
    is_con = (n > 0) & (lead <= -2) & (avg_c > avg_s)
    is_part = (n > 0) & (lead > 0) & (score >= 0.40)
    v = F.when(is_sup, "supported").when(is_con, "contradicted").when(is_part, "partially_supported").otherwise("inconclusive")
    top = F.lit(0.95)
    c = F.when(n == 0, 0.0).when(is_sup, F.least(top, score + 0.10)).when(is_con, F.least(top, F.greatest(F.lit(0.35), 0.45 + 0.05 * F.abs(lead)))).when(is_part, F.least(top, score)).otherwise(F.least(F.lit(0.75), F.greatest(F.lit(0.20), score)))
    return v, c
