"""Queries of the streaming group (STR): each runs its stream over all that is there and must equal the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..streaming import feeds
from .registry import FEED, query


@query("str01_refresh", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, value FROM x WHERE r=1")
def str01(spark, d):
    return feeds.last_known(spark, d).select("user_id", "event_type", "event_id", "value")


@query("str02_last_known_good", f"{FEED} SELECT event_id, provider_id, kind, edge_id FROM g_traffic WHERE NOT (provider_id='here' AND kind='flow') OR event_id%2=0")
def str02(spark, d):
    t = graph.traffic(spark, d).select("event_id", "provider_id", "kind", "edge_id")
    sources = t.select("provider_id", "kind").distinct().withColumn("ok", ~((F.col("provider_id") == "here") & (F.col("kind") == "flow")))
    return feeds.or_last_known(t, sources, t.where("event_id % 2 = 0"))


@query("str04_unique_events", "SELECT event_id, event_type FROM events")
def str04(spark, d):
    return feeds.unique_events(spark, d).select("event_id", "event_type")


@query("str05_tumbling_windows", "SELECT event_type, CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS start, count(*) AS events FROM events GROUP BY 1,2")
def str05(spark, d):
    return feeds.windows(spark, d).select("event_type", F.unix_seconds("window.start").alias("start"), "events")


@query("str09_generation_resolution", "SELECT event_id, CASE WHEN event_id%4=0 THEN 'no base' WHEN event_id%6=0 THEN 'no closures' WHEN event_id%9=0 THEN 'fallback' ELSE 'available' END AS state FROM events")
def str09(spark, d):
    e = F.col("event_id")
    return graph.table(spark, d, "events").select("event_id", F.when(e % 4 == 0, "no base").when(e % 6 == 0, "no closures").when(e % 9 == 0, "fallback").otherwise("available").alias("state"))
