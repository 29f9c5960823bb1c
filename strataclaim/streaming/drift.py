"""Claim tracking as a stream: state by claim, updated as evidence arrives.

The state of a claim is (n, alpha, beta, both change sums, last recorded time and id); evidence of one
micro-batch is applied in order of (recorded_at, id). Fed in order, the last output of each claim
equals the last row of the batch operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataclaim.operators.drift import SLACK, TARGET, THRESHOLD

OUT = "claim_id long, n long, alpha double, beta double, belief double, cusum_pos double, cusum_neg double, alert boolean"
STATE = "n long, alpha double, beta double, cusum_pos double, cusum_neg double"


def _update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, alpha, beta, pos, neg = state.get if state.exists else (0, 1.0, 1.0, 0.0, 0.0)
    rows = pd.concat(list(parts)).sort_values(["recorded_at", "id"])
    for direction, weight in zip(rows["direction"], rows["weight"]):
        n += 1
        if direction == "supports":
            alpha += weight
        elif direction == "contradicts":
            beta += weight
        belief = alpha / (alpha + beta)
        pos = max(0.0, pos + belief - TARGET - SLACK)
        neg = max(0.0, neg + TARGET - belief - SLACK)
    state.update((n, alpha, beta, pos, neg))
    yield pd.DataFrame({"claim_id": [key[0]], "n": [n], "alpha": [alpha], "beta": [beta], "belief": [alpha / (alpha + beta)], "cusum_pos": [pos], "cusum_neg": [neg], "alert": [max(pos, neg) > THRESHOLD]})


def track_stream(evidence: DataFrame) -> DataFrame:
    """The state of each claim after each micro-batch; ``evidence`` as the batch operator takes it."""
    return evidence.groupBy("claim_id").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(evidence: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Evidence by direction in event-time windows; rows later than ``late`` are left out."""
    from pyspark.sql import functions as F

    w = F.window("recorded_at", window, slide) if slide else F.window("recorded_at", window)
    return evidence.withWatermark("recorded_at", late).groupBy("direction", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def new_only(stream: DataFrame, key: str, time: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark: the ledger of what was processed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
