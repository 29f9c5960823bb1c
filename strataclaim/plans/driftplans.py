"""Queries of claim tracking over the event stream, and window patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataclaim.operators import drift
from strataclaim.plans.catalog import query
from strataclaim.session import table

EVIDENCE = """SELECT event_id AS id, user_id AS claim_id, CASE WHEN event_type IN ('purchase', 'click', 'signup') THEN 'supports' WHEN event_type = 'error' THEN 'contradicts' ELSE 'neutral' END AS direction,
 CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 2.5 WHEN 'click' THEN 1.0 WHEN 'error' THEN 2.5 ELSE 0.5 END::DOUBLE AS weight, ts AS recorded_at FROM events"""

TRACK = f"""WITH e AS ({EVIDENCE}),
p AS (SELECT *, row_number() OVER w AS n, 1 + sum(CASE WHEN direction = 'supports' THEN weight ELSE 0 END) OVER w AS alpha, 1 + sum(CASE WHEN direction = 'contradicts' THEN weight ELSE 0 END) OVER w AS beta FROM e WINDOW w AS (PARTITION BY claim_id ORDER BY recorded_at, id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, alpha / (alpha + beta) AS belief, alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)) AS uncertainty FROM p),
s AS (SELECT *, sum(belief - 0.77) OVER w AS su, sum(0.73 - belief) OVER w AS sd FROM b WINDOW w AS (PARTITION BY claim_id ORDER BY recorded_at, id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, su - least(0.0, min(su) OVER w) AS cusum_pos, sd - least(0.0, min(sd) OVER w) AS cusum_neg FROM s WINDOW w AS (PARTITION BY claim_id ORDER BY recorded_at, id ROWS UNBOUNDED PRECEDING))"""

_LAST = TRACK + ", l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY recorded_at DESC, id DESC) = 1)"


def _tracked(spark: SparkSession, d: str) -> DataFrame:
    return drift.track(drift.claim_evidence(table(spark, d, "events")))


def _r(c: str, n: int = 5) -> F.Column:
    return F.round(c, n).alias(c)


@query(_LAST + """ SELECT claim_id, n, round(alpha, 5) AS alpha, round(beta, 5) AS beta, round(belief, 5) AS belief, round(uncertainty, 5) AS uncertainty, round(cusum_pos, 5) AS cusum_pos, round(cusum_neg, 5) AS cusum_neg,
 CASE WHEN cusum_pos > 1.5 THEN 'strengthening' WHEN cusum_neg > 1.5 THEN 'weakening' WHEN cusum_neg > 0.8 THEN 'slight_weakening' WHEN cusum_pos > 0.8 THEN 'slight_strengthening' ELSE 'stable' END AS drift FROM l""")
def drift_state(spark: SparkSession, d: str) -> DataFrame:
    """Final belief, uncertainty, change sums and drift status of every claim."""
    s = drift.latest(_tracked(spark, d))
    return s.select("claim_id", "n", *map(_r, ("alpha", "beta", "belief", "uncertainty", "cusum_pos", "cusum_neg")), drift.status(F.col("cusum_pos"), F.col("cusum_neg")).alias("drift"))


@query(TRACK + " SELECT claim_id, n, round(belief, 5) AS belief, round(cusum_pos, 5) AS cusum_pos, round(cusum_neg, 5) AS cusum_neg, CAST(cusum_pos > 1.5 OR cusum_neg > 1.5 AS BOOLEAN) AS alert FROM t")
def drift_history(spark: SparkSession, d: str) -> DataFrame:
    """Belief and change sums after every piece of evidence, with alerts."""
    return _tracked(spark, d).select("claim_id", "n", *map(_r, ("belief", "cusum_pos", "cusum_neg")), ((F.col("cusum_pos") > drift.THRESHOLD) | (F.col("cusum_neg") > drift.THRESHOLD)).alias("alert"))


@query(_LAST + " SELECT claim_id, round(belief, 3) AS belief, CASE WHEN cusum_pos > cusum_neg THEN 'strengthening' ELSE 'weakening' END AS direction, round(greatest(cusum_pos, cusum_neg), 2) AS magnitude FROM l WHERE cusum_pos > 1.0 OR cusum_neg > 1.0")
def drifting_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims with a change sum over 1."""
    s = drift.latest(_tracked(spark, d)).where("cusum_pos > 1.0 or cusum_neg > 1.0")
    return s.select("claim_id", F.round("belief", 3).alias("belief"), F.when(F.col("cusum_pos") > F.col("cusum_neg"), "strengthening").otherwise("weakening").alias("direction"), F.round(F.greatest("cusum_pos", "cusum_neg"), 2).alias("magnitude"))


_AS_OF = "2024-01-30 00:00:00"


@query(f"""WITH e AS ({EVIDENCE}), c AS (SELECT claim_id, weight, row_number() OVER (PARTITION BY claim_id ORDER BY recorded_at, id) - 1 AS k FROM e WHERE direction = 'contradicts' AND recorded_at > TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAYS)
SELECT claim_id, count(*) AS n, round(coalesce(CASE WHEN count(*) < 2 THEN 0.0 ELSE regr_slope(weight, k) END, 0.0), 4) AS velocity FROM c GROUP BY claim_id""")
def contradiction_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Slope of contradiction weights by their order, over a trailing window."""
    e = drift.claim_evidence(table(spark, d, "events")).where((F.col("direction") == "contradicts") & (F.col("recorded_at") > F.expr(f"timestamp '{_AS_OF}' - interval 30 days")))
    k = F.row_number().over(Window.partitionBy("claim_id").orderBy("recorded_at", "id")) - 1
    g = e.withColumn("k", k).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("weight", "k").alias("s"))
    return g.select("claim_id", "n", F.round(F.coalesce(F.when(F.col("n") < 2, 0.0).otherwise(F.col("s")), F.lit(0.0)), 4).alias("velocity"))


@query(f"""WITH e AS ({EVIDENCE}), q AS (SELECT *, date_diff('day', CAST(recorded_at AS DATE), DATE '2024-02-01') AS days FROM e)
SELECT direction, count(*) AS n, round(sum(weight * exp(-days / 365.0)), 4) AS decayed, round(sum(weight), 4) AS weight FROM q GROUP BY direction""")
def decayed_weights(spark: SparkSession, d: str) -> DataFrame:
    """Evidence weights decayed by age in whole days."""
    e = drift.claim_evidence(table(spark, d, "events")).withColumn("days", F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("recorded_at")))
    return e.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("weight") * F.exp(-F.col("days") / 365.0)), 4).alias("decayed"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"""WITH e AS ({EVIDENCE}), x AS (SELECT claim_id, list(weight / 3.0 ORDER BY recorded_at, id) AS xs FROM e GROUP BY claim_id)
SELECT claim_id, round(list_reduce(list_prepend({{'ema': 0.0::DOUBLE, 'n': 0, 'x': 0.0::DOUBLE}}, list_transform(xs, lambda x: {{'ema': 0.0::DOUBLE, 'n': 0, 'x': x}})), lambda a, b: {{'ema': (CASE WHEN a.n > 20 THEN 0.35 ELSE greatest(0.20, least(0.55, 0.55 - 0.01 * a.n)) END) * b.x + (1 - (CASE WHEN a.n > 20 THEN 0.35 ELSE greatest(0.20, least(0.55, 0.55 - 0.01 * a.n)) END)) * a.ema, 'n': a.n + 1, 'x': 0.0::DOUBLE}}).ema, 5) AS ema, len(xs)::INT AS n FROM x""")
def persistence_ema(spark: SparkSession, d: str) -> DataFrame:
    """Exponential mean whose weight depends on the number of updates before; an ordered fold by key."""
    e = drift.claim_evidence(table(spark, d, "events"))
    xs = e.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("recorded_at", "id", (F.col("weight") / 3.0).alias("x")))).alias("xs"))

    def step(acc, r):
        a = F.when(acc["n"] > 20, F.lit(0.35)).otherwise(F.greatest(F.lit(0.20), F.least(F.lit(0.55), F.lit(0.55) - F.lit(0.01) * acc["n"])))
        return F.struct((a * r["x"] + (F.lit(1.0) - a) * acc["ema"]).alias("ema"), (acc["n"] + 1).alias("n"))

    folded = F.aggregate("xs", F.struct(F.lit(0.0).alias("ema"), F.lit(0).alias("n")), step)
    return xs.select("claim_id", F.round(folded["ema"], 5).alias("ema"), F.size("xs").alias("n"))


@query(TRACK + """, h AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY recorded_at DESC, id DESC) AS back FROM t)
SELECT claim_id, back, round(belief, 4) AS belief, round(alpha, 3) AS alpha, round(beta, 3) AS beta FROM h WHERE back <= 10""")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    """The last ten states of each claim."""
    back = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("recorded_at"), F.desc("id"))).cast("long")
    return _tracked(spark, d).withColumn("back", back).where("back <= 10").select("claim_id", "back", F.round("belief", 4).alias("belief"), F.round("alpha", 3).alias("alpha"), F.round("beta", 3).alias("beta"))


@query(TRACK + """, c AS (SELECT claim_id, n, belief, lag(belief) OVER (PARTITION BY claim_id ORDER BY n) AS prev FROM t)
SELECT claim_id, n, CASE WHEN belief - prev >= 0.05 THEN 'strengthened' ELSE 'weakened' END AS event, round(belief - prev, 5) AS change FROM c WHERE abs(belief - prev) >= 0.05""")
def change_events(spark: SparkSession, d: str) -> DataFrame:
    """Changes of belief by .05 or more against the state before."""
    prev = F.lag("belief").over(Window.partitionBy("claim_id").orderBy("n"))
    c = _tracked(spark, d).withColumn("prev", prev).withColumn("diff", F.col("belief") - F.col("prev")).where(F.abs("diff") >= 0.05)
    return c.select("claim_id", "n", F.when(F.col("diff") >= 0.05, "strengthened").otherwise("weakened").alias("event"), F.round("diff", 5).alias("change"))


@query(f"""WITH e AS ({EVIDENCE}) SELECT direction, strftime(time_bucket(INTERVAL 1 DAY, recorded_at), '%Y-%m-%d') AS day, count(*) AS n, round(sum(weight), 4) AS weight FROM e GROUP BY ALL""")
def evidence_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Evidence in tumbling windows of a day."""
    e = drift.claim_evidence(table(spark, d, "events")).groupBy("direction", F.window("recorded_at", "1 day").alias("w"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight")).select("direction", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "weight")


@query(f"""WITH e AS ({EVIDENCE}), s AS (SELECT *, time_bucket(INTERVAL 1 DAY, recorded_at) - INTERVAL 1 DAY * unnest([0, 1, 2]) AS ws FROM e)
SELECT direction, strftime(ws, '%Y-%m-%d') AS start_day, count(*) AS n FROM s GROUP BY ALL""")
def evidence_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Evidence in windows of three days that slide by one."""
    e = drift.claim_evidence(table(spark, d, "events")).groupBy("direction", F.window("recorded_at", "3 days", "1 day").alias("w"))
    return e.agg(F.count(F.lit(1)).alias("n")).select("direction", F.date_format("w.start", "yyyy-MM-dd").alias("start_day"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, sid""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user's events, with gaps under six hours."""
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query(TRACK + """, q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT q.event_id, round(t.belief, 5) AS belief_then FROM q ASOF JOIN t ON q.user_id = t.claim_id AND q.ts > t.recorded_at""")
def belief_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The belief in force just before each view: an as-of join as one window over both sides."""
    t = _tracked(spark, d).select(F.col("claim_id").alias("k"), F.col("recorded_at").alias("ts"), F.col("id"), "belief", F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("side"))
    q = table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("k"), "ts", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("belief"), "event_id", F.lit(0).alias("side"))
    # questions come before evidence of the same moment, so only earlier evidence is in force
    w = Window.partitionBy("k").orderBy("ts", "side", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = t.unionByName(q).withColumn("belief_then", F.last("belief", ignorenulls=True).over(w))
    return both.where("event_id is not null and belief_then is not null").select("event_id", F.round("belief_then", 5).alias("belief_then"))
