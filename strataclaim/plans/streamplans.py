"""Queries that run a stream to its end over a table and give its final state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataclaim.operators.drift import claim_evidence
from strataclaim.plans.catalog import query
from strataclaim.plans.driftplans import EVIDENCE, TRACK
from strataclaim.session import shared_dir, table
from strataclaim.streaming import drift


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    # watermarks need an instant; the session's zone is UTC, so the wall clock stays the same
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(spark: SparkSession, out: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read its output table in the shared folder."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda b, n: write(b.drop("batch"), n)).start()
    q.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")


@query(TRACK + ", l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY recorded_at DESC, id DESC) = 1) SELECT claim_id, n, round(alpha, 5) AS alpha, round(beta, 5) AS beta, round(cusum_pos, 5) AS cusum_pos, round(cusum_neg, 5) AS cusum_neg FROM l")
def stream_drift_state(spark: SparkSession, d: str) -> DataFrame:
    """Final state of every claim, from a stream with state by claim."""
    out = _finish(spark, drift.track_stream(claim_evidence(_events(spark, d))), "update")
    last = out.groupBy("claim_id").agg(F.max_by(F.struct("n", "alpha", "beta", "cusum_pos", "cusum_neg"), "n").alias("s")).select("claim_id", "s.*")
    return last.select("claim_id", "n", *(F.round(c, 5).alias(c) for c in ("alpha", "beta", "cusum_pos", "cusum_neg")))


@query(f"WITH e AS ({EVIDENCE}) SELECT direction, strftime(time_bucket(INTERVAL 1 DAY, recorded_at), '%Y-%m-%d') AS day, count(*) AS n FROM e GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Evidence by day from a stream with a watermark, in update mode; the last count of each window."""
    out = _finish(spark, drift.windowed_counts(claim_evidence(_events(spark, d))), "update")
    return out.groupBy("direction", F.date_format("w.start", "yyyy-MM-dd").alias("day")).agg(F.max("n").alias("n"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_distinct_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that a ledger lets through once each."""
    return _finish(spark, drift.new_only(_events(spark, d), "event_id", "ts"), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
