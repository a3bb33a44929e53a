"""The live-check feed as a stream and in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import scratch_path
from ..streaming import refresh
from .registry import query
from .tables import load

# Events are live checks of a user's purchases: the live total is the event's
# value, the published total the user's number of purchases.

_PUBLISHED_SQL = """pub AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS published,
  CASE WHEN user_id % 3 <> 0 THEN min(ts) - INTERVAL 20 DAY END AS last_check FROM events GROUP BY user_id)"""


def _published(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("published"), F.min("ts").alias("first")
    ).select(
        F.col("user_id").cast("string").alias("code"), "published",
        F.when(F.col("user_id") % 3 != 0, F.col("first") - F.expr("interval 20 days")).alias("last_check"),
    )


def _feed(spark, sf) -> str:
    """The events as feed lines; some carry no numeric total."""
    k = F.col("event_id")
    d = load(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "other").otherwise("live-check").alias("kind"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ranAt"), F.col("user_id").cast("string").alias("orphaCode"),
        F.when(k % 31 == 0, "many").otherwise(F.floor("value").cast("string")).alias("liveTotal"), F.lit(0).alias("publishedTotal"),
    )
    path = scratch_path(spark, "feed")
    d.write.json(path)
    return path


_VALID_SQL = "ok AS (SELECT *, floor(value)::BIGINT AS live FROM events WHERE event_type <> 'error' AND event_id % 31 <> 0)"
_REASON_SQL = f"""{_PUBLISHED_SQL}, {_VALID_SQL}, why AS (SELECT ok.*, published, CASE WHEN live <> published THEN 'live-delta' WHEN last_check IS NULL THEN 'missing-last-check'
  WHEN epoch(ts) - epoch(last_check) > 30 * 86400 THEN 'stale-check' END AS reason FROM ok JOIN pub USING (user_id))"""


@query("live_events", f"WITH {_VALID_SQL} SELECT CAST(user_id AS VARCHAR) AS code, live AS live_total, ts AS spot FROM ok")
def _(spark, sf):
    events = spark.read.schema(refresh.EVENT).json(_feed(spark, sf))
    return refresh.live_events(events)[0].select("code", "live_total", F.col("at").alias("spot"))


@query("rejected_events", "SELECT CAST(user_id AS VARCHAR) AS code, count(*) AS n FROM events WHERE event_type = 'error' OR event_id % 31 = 0 GROUP BY 1")
def _(spark, sf):
    events = spark.read.schema(refresh.EVENT).json(_feed(spark, sf))
    return refresh.live_events(events)[1].groupBy(F.col("orphaCode").alias("code")).agg(F.count("*").alias("n"))


@query("queue_reasons", f"WITH {_REASON_SQL} SELECT CAST(user_id AS VARCHAR) AS code, ts AS spot, reason FROM why WHERE reason IS NOT NULL")
def _(spark, sf):
    events = spark.read.schema(refresh.EVENT).json(_feed(spark, sf))
    d = refresh.queue_reasons(refresh.live_events(events)[0], _published(spark, sf))
    return d.select("code", F.col("at").alias("spot"), "reason")


@query("refresh_queue", """
SELECT CAST(user_id AS VARCHAR) AS code, max(event_id) AS seq FROM events WHERE event_type IN ('view', 'purchase') AND ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 14 DAY GROUP BY user_id""")
def _(spark, sf):
    e = load(spark, sf, "events").select(
        F.when(F.col("event_type") == "view", "live-check").when(F.col("event_type") == "purchase", "refresh-queue").otherwise("other").alias("kind"),
        F.col("user_id").cast("string").alias("code"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("reason"),
    )
    return refresh.refresh_queue(e, F.lit("2024-01-30").cast("timestamp")).select("code", "seq")


@query("refresh_stream", f"""WITH {_REASON_SQL}, l AS (SELECT user_id, arg_max(reason, (ts, reason)) AS reason, max(ts) AS spot FROM why WHERE reason IS NOT NULL GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS code, spot, reason FROM l WHERE spot >= (SELECT max(spot) FROM l) - INTERVAL 14 DAY""")
def _(spark, sf):
    table = scratch_path(spark, "queue")
    running = refresh.run_refresh(spark, _feed(spark, sf), _published(spark, sf), table, scratch_path(spark, "rejects"))
    for q in running:
        q.awaitTermination()
    return refresh.read_queue(spark, table).select("code", F.col("at").alias("spot"), "reason")
