"""Live traffic: normalising provider payloads, resolving conflicts, composing edge updates, judging and choosing routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.geo import c

LIFETIME_S = {"flow": 120, "incident": 300, "closure": 900, "restriction": 900}
#: Points of the structural score, by what a route has.
FRICTION = {"maneuvers": 1, "signals": 4, "stops": 3, "yields": 2, "ramps": 5, "tolls": 8, "ferries": 12, "delay_s": 1, "incidents": 180, "lane": 1}
NEAR_TIE = {"fastest": (90.0, 0.1), "shortest": (1000.0, 0.1), "easiest": (10.0, 0.1)}
SWITCH_SECONDS, SWITCH_SHARE = 120, 0.1


def provider_a_flow(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Flow records of the provider whose payload is one flowSegmentData."""
    g = lambda *p, kind="string": scalar.json_first(body, *[f"$.flowSegmentData.{x}" for x in p], kind=kind)
    speed, free = g("currentSpeed", kind="double"), g("freeFlowSpeed", kind="double")
    closed = F.coalesce(g("roadClosure", kind="boolean"), F.lit(False))
    return payloads.select(
        "payload_id", F.lit("tomtom").alias("provider_id"), F.when(closed, "closure").otherwise("flow").alias("kind"), closed.alias("closed"), speed.alias("speed_kph"), free.alias("free_kph"),
        scalar.delay_seconds(F.lit(None).cast("double"), g("currentTravelTime", kind="double"), g("freeFlowTravelTime", kind="double")).alias("delay_s"),
        scalar.confidence(g("confidence", kind="double")).alias("confidence"), g("observedAt", "updatedAt").try_cast("timestamp").alias("observed_at"),
        g("validUntil").try_cast("timestamp").alias("valid_until"), F.when(closed, "closed").otherwise(scalar.flow_severity(speed, free)).alias("severity"),
    )


def provider_b_flow(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Flow records of the provider whose payload is a list of results in metres per second."""
    rows = payloads.select("payload_id", F.posexplode(F.from_json(body, "results array<struct<id:string,currentFlow:struct<speed:double,freeFlow:double,traversalTime:double,freeFlowTravelTime:double,confidence:double,jamFactor:double,traversability:string,observedAt:string,validUntil:string>>>")["results"]).alias("ordinal", "r"))
    f = lambda x: F.col(f"r.currentFlow.{x}")
    speed, free = f("speed") * 3.6, f("freeFlow") * 3.6
    closed = F.coalesce((f("jamFactor") >= 10) | f("traversability").isin("closed", "reversibleNotRoutable"), F.lit(False))
    return rows.select(
        "payload_id", F.lit("here").alias("provider_id"), F.when(closed, "closure").otherwise("flow").alias("kind"), closed.alias("closed"), speed.alias("speed_kph"), free.alias("free_kph"),
        scalar.delay_seconds(F.lit(None).cast("double"), f("traversalTime"), f("freeFlowTravelTime")).alias("delay_s"), scalar.confidence(f("confidence")).alias("confidence"),
        f("observedAt").try_cast("timestamp").alias("observed_at"), f("validUntil").try_cast("timestamp").alias("valid_until"), F.when(closed, "closed").otherwise(scalar.flow_severity(speed, free)).alias("severity"),
    )


def malformed(speed, edge) -> Column:
    """Why a record cannot be used, null if it can."""
    return F.when(c(speed).isNull() | F.isnan(c(speed).cast("double")), "speed missing").when(c(speed) < 0, "speed below zero").when(c(edge).isNull(), "no geometry")


def split_malformed(records: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good records, diagnostics)"""
    r = records.withColumn("reason", reason)
    return r.where("reason is null").drop("reason"), r.where("reason is not null")


def expiry(valid_until, freshness, kind) -> Column:
    """valid_until, else the freshness and the lifetime of its kind."""
    life = F.create_map(*[F.lit(x) for k, v in LIFETIME_S.items() for x in (k, v)])[c(kind)]
    return F.coalesce(c(valid_until), F.timestamp_seconds(F.unix_seconds(c(freshness)) + F.coalesce(life, F.lit(120))))


def resolve(updates: DataFrame, priority: Column | None = None) -> DataFrame:
    """One update for each edge and layer: a closure, then confidence, freshness, provider priority, provider, event id.

    Updates whose direction is not resolved all pass. Ties end with the event id, which is unique.
    """
    w = Window.partitionBy("edge_id", "layer").orderBy(F.col("closed").desc(), F.col("confidence_pct").desc(), F.col("freshness").desc(), (priority if priority is not None else F.lit(0)).desc(), "provider_id", "event_id")
    best = updates.where("direction_resolved").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return best.unionByName(updates.where("not direction_resolved"))


def compose(updates: DataFrame) -> DataFrame:
    """One row for each edge: the speed and provider of the most confident update, closed if any is, incident if any is."""
    best = F.max_by(F.struct("speed_kph", "provider_id"), F.struct("confidence_pct", "event_id"))
    out = updates.where("direction_resolved").groupBy("edge_id").agg(best.alias("b"), F.bool_or("closed").alias("closed"), F.bool_or(F.col("kind") == "incident").alias("incident"), F.count(F.lit(1)).alias("updates"))
    return out.select("edge_id", "b.speed_kph", "b.provider_id", "closed", "incident", "updates")


def encode_speed(speed, closed, delay, length) -> tuple[Column, Column]:
    """(raw speed in steps of two km/h, 127 unknown; congestion) of a live record."""
    step = lambda kph: F.when(kph.isNotNull(), F.least(F.lit(126), F.greatest(F.lit(1), F.floor(kph / 2.0 + 0.5)))).cast("long")
    raw, from_delay = step(c(speed)), step(c(length) * 3.6 / F.nullif(c(delay).cast("double"), F.lit(0.0)))
    return F.when(c(closed), 0).otherwise(F.coalesce(raw, from_delay, F.lit(127))).cast("long"), F.when(c(closed), 63).otherwise(0)


def policy(updates: DataFrame, enabled: bool) -> DataFrame:
    """All updates, or with traffic off closures alone, without delay."""
    return updates if enabled else updates.where("closed").withColumn("delay_s", F.lit(None).cast("long"))


def impact(kind, closed, direction_resolved, keep_closures: bool = True) -> tuple[Column, Column]:
    """(kind of impact, hard deny)"""
    k = F.when(c(closed), "closure").otherwise(c(kind))
    return k, F.lit(keep_closures) & c(closed) & c(direction_resolved)


def evaluate(routes: DataFrame, updates: DataFrame) -> DataFrame:
    """For each route (route_id, edge_id): delay_s (the most of each source, summed), incidents, hard_deny. Routes without traffic have 0.

    The best update of each edge, provider and event counts: direction-resolved, then of more confidence, closed, of more delay.
    """
    w = Window.partitionBy("edge_id", "provider_id", "event_id").orderBy(F.col("direction_resolved").desc(), F.col("confidence_pct").desc(), F.col("closed").desc(), F.col("delay_s").desc_nulls_last(), "kind")
    own = updates.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    hit = routes.select("route_id", "edge_id").distinct().join(own, "edge_id")
    source = hit.groupBy("route_id", "provider_id", "event_id").agg(F.max("delay_s").alias("delay"), F.bool_or(F.col("kind") == "incident").alias("incident"), F.bool_or(F.col("closed") & F.col("direction_resolved")).alias("deny"))
    total = source.groupBy("route_id").agg(scalar.saturating(F.sum("delay")).alias("delay_s"), F.sum(F.col("incident").cast("long")).alias("incidents"), F.bool_or("deny").alias("hard_deny"))
    every = routes.select("route_id").distinct().join(total, "route_id", "left")
    return every.select("route_id", F.coalesce("delay_s", F.lit(0).cast("long")).alias("delay_s"), F.coalesce("incidents", F.lit(0).cast("long")).alias("incidents"), F.coalesce("hard_deny", F.lit(False)).alias("hard_deny"))


def adjusted_eta(duration, delay, includes_traffic) -> Column:
    return scalar.saturating(F.when(c(includes_traffic), c(duration)).otherwise(c(duration) + c(delay)))


def structural_friction(counts: dict[str, Column]) -> Column:
    """The weighted sum of what a route has; what is not given counts 0."""
    return scalar.saturating(sum((c(counts[k]) * w for k, w in FRICTION.items() if k in counts), F.lit(0).cast("long")))


def lane_friction(changes, truck, sensitive) -> Column:
    """Of lane changes: 8 each for cars, 14 for trucks, and 1.75 times that where trucks should not change."""
    each = F.when(c(truck), 14).otherwise(8)
    return scalar.saturating(F.ceil(c(changes) * each * F.when(c(truck) & c(sensitive), 1.75).otherwise(1.0)))


def rank(candidates: DataFrame, metric: str, goal: str, score: str = "score") -> DataFrame:
    """Candidates of a query in order of preference: the near ties of the best metric by score, then the others by metric.

    candidates: query_id, route_index, the metric and the score. Adds near_tie, normal (the metric in 0..1 in its pool) and rank.
    """
    most, share = NEAR_TIE[goal]
    q = Window.partitionBy("query_id")
    best = F.min(metric).over(q)
    out = candidates.withColumn("near_tie", F.col(metric) <= best + F.greatest(F.lit(most), best * share))
    pool = Window.partitionBy("query_id", "near_tie")
    low, high = F.min(metric).over(pool), F.max(metric).over(pool)
    out = out.withColumn("normal", F.when(high == low, F.lit(0.0)).otherwise((F.col(metric) - low) / (high - low)))
    order = q.orderBy(F.col("near_tie").desc(), F.when(F.col("near_tie"), F.col(score)).asc_nulls_last(), metric, "route_index")
    return out.withColumn("rank", F.row_number().over(order).cast("long"))


def distinct_routes(candidates: DataFrame) -> DataFrame:
    """Of routes of one identity, the safest, then the one of the lowest index."""
    w = Window.partitionBy("query_id", "identity").orderBy("hard_deny", "incidents", "route_index")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rank_shift(normal: DataFrame, modified: DataFrame) -> DataFrame:
    """Identities of the normal ranking that vanished or fell: query_id, identity, old_rank, new_rank, change."""
    a = normal.select("query_id", "identity", F.col("rank").alias("old_rank"))
    b = modified.select("query_id", "identity", F.col("rank").alias("new_rank"))
    change = F.when(F.col("old_rank").isNull(), "new").when(F.col("new_rank").isNull(), "vanished").when(F.col("new_rank") > F.col("old_rank"), "fell").otherwise("same")
    return a.join(b, ["query_id", "identity"], "full_outer").withColumn("change", change)


def decide(current_eta, best_eta, current_denied) -> Column:
    """What a planner does with a route under way."""
    gain = c(current_eta) - c(best_eta)
    return F.when(c(current_denied), "replace").when((gain >= SWITCH_SECONDS) & (gain >= c(current_eta) * SWITCH_SHARE), "switch").when(gain > 0, "suggest").otherwise("keep")
