"""Tracking of claims over streams of evidence: Beta posteriors and two-sided CUSUM, as windows.

The recursion C_n = max(0, C_(n-1) + x_n) has the closed form C_n = S_n - min(0, min S), with S the
running sum of x, so the state of every claim after each piece of evidence is a stack of window sums
over one partitioning by claim, without a UDF. Direction other than support or contradiction changes
neither parameter but still advances the history and both sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET, SLACK, THRESHOLD = 0.75, 0.02, 1.5

#: Weight and direction of event types in the evidence view.
EVENT_WEIGHTS = {"purchase": 3.0, "signup": 2.5, "click": 1.0, "error": 2.5}
OTHER_WEIGHT = 0.5
SUPPORTING, CONTRADICTING = ("purchase", "click", "signup"), ("error",)


def claim_evidence(events: DataFrame) -> DataFrame:
    """Evidence ``(id, claim_id, direction, weight, recorded_at)`` from the event stream table."""
    kind = F.col("event_type")
    weight = F.lit(OTHER_WEIGHT)
    for name, w in EVENT_WEIGHTS.items():
        weight = F.when(kind == name, F.lit(w)).otherwise(weight)
    direction = F.when(kind.isin(*SUPPORTING), "supports").when(kind.isin(*CONTRADICTING), "contradicts").otherwise("neutral")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("claim_id"), direction.alias("direction"), weight.alias("weight"), F.col("ts").alias("recorded_at"))


def track(evidence: DataFrame, target: float = TARGET, slack: float = SLACK) -> DataFrame:
    """State of each claim after each piece of its evidence, in order of (recorded_at, id)."""
    order = Window.partitionBy("claim_id").orderBy("recorded_at", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    side = lambda d: F.when(F.col("direction") == d, F.col("weight")).otherwise(0.0)
    df = evidence.withColumns({"n": F.row_number().over(order).cast("long"), "alpha": 1 + F.sum(side("supports")).over(upto), "beta": 1 + F.sum(side("contradicts")).over(upto)})
    total = F.col("alpha") + F.col("beta")
    df = df.withColumns({"belief": F.col("alpha") / total, "uncertainty": F.col("alpha") * F.col("beta") / (total * total * (total + 1))})
    up, down = F.col("belief") - (target + slack), (target - slack) - F.col("belief")
    df = df.withColumns({"s_up": F.sum(up).over(upto), "s_down": F.sum(down).over(upto)})
    closed = lambda s: F.col(s) - F.least(F.lit(0.0), F.min(s).over(upto))
    return df.withColumns({"cusum_pos": closed("s_up"), "cusum_neg": closed("s_down")}).drop("s_up", "s_down")


def status(pos: Column, neg: Column) -> Column:
    """Drift status of a pair of sums; the negative side is looked at first among slight ones."""
    return F.when(pos > THRESHOLD, "strengthening").when(neg > THRESHOLD, "weakening").when(neg > 0.8, "slight_weakening").when(pos > 0.8, "slight_strengthening").otherwise("stable")


def latest(tracked: DataFrame) -> DataFrame:
    """The last state of each claim, by a map-side combined aggregation."""
    cols = ["recorded_at", "id", "n", "alpha", "beta", "belief", "uncertainty", "cusum_pos", "cusum_neg"]
    last = tracked.groupBy("claim_id").agg(F.max(F.struct(*cols)).alias("s"))
    return last.select("claim_id", *(F.col(f"s.{c}").alias(c) for c in cols))
