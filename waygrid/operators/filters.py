"""Predicates of edges, labels, times and candidates as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import c

IMPASSABLE = 7


def has_access(access, mode: int) -> Column:
    return c(access).bitwiseAND(mode) != 0


def allowed(edge: dict, mode: int, u_turn=None, avoided=None, allow_destination_only: bool = False, exclude_unpaved: bool = False, ignore_closures: bool = False) -> Column:
    """Whether a label may expand onto an edge: access, no U-turn, no simple turn restriction, passable, not shut to through traffic.

    edge: access, surface, dest, closed, unpaved, forbidden (bit mask over local numbers of the next edge) and local.
    """
    ok = has_access(edge["access"], mode) & (F.call_function("shiftright", c(edge["forbidden"]), c(edge["local"])).bitwiseAND(1) == 0) & (edge["surface"] != IMPASSABLE)
    if u_turn is not None:
        ok = ok & ~c(u_turn)
    if avoided is not None:
        ok = ok & ~c(avoided)
    if not allow_destination_only:
        ok = ok & ~edge["dest"]
    if not ignore_closures:
        ok = ok & ~edge["closed"]
    return ok & ~edge["unpaved"] if exclude_unpaved else ok


def hov_allowed(kind, tolled, hov2: bool, hov3: bool, hot: bool) -> Column:
    """Three aboard may use all, two the lanes for two, others tolled lanes if they pay."""
    if hov3:
        return F.lit(True)
    return (c(kind) == "none") | (F.lit(hov2) & (c(kind) == "hov2")) | (F.lit(hot) & (c(kind) == "hot") & c(tolled))


def exclusion_ok(has, before_has, reverse: bool = False) -> Column:
    """An exclusion denies only where the state changes: an edge that has it after one that has not (searched backwards: the other way)."""
    return ~(~c(has) & c(before_has)) if reverse else ~(c(has) & ~c(before_has))


def within_limits(edges: DataFrame, limits: DataFrame, vehicle: dict[str, float]) -> DataFrame:
    """Edges none of whose limits (edge_id, kind, value in hundredths) the vehicle exceeds; kinds that it lacks do not bind."""
    too = None
    for kind, value in vehicle.items():
        over = (F.col("kind") == kind) & (F.lit(value) > F.col("value") * 0.01)
        too = over if too is None else too | over
    return edges.join(limits.where(too).select("edge_id"), "edge_id", "left_anti")


def in_time_domain(ts, dow_mask: int = 127, begin_minute: int = 0, end_minute: int = 1440) -> Column:
    """Weekday (bit 0 is Sunday) and minutes of the day. A range that ends before it begins is the negated inside test."""
    minute = F.hour(c(ts)) * 60 + F.minute(c(ts))
    day = F.element_at(F.array(*[F.lit(1 << k) for k in range(7)]), F.dayofweek(c(ts))).bitwiseAND(dow_mask) != 0
    inside = minute.between(begin_minute, end_minute) if begin_minute <= end_minute else ~minute.between(end_minute, begin_minute)
    return day & inside


def nth_weekday(ts, dow: int, n: int) -> Column:
    """Day of the month of the n-th weekday (1 is Sunday) of a time's month; n = 5 is the last."""
    first = F.trunc(c(ts), "month")
    day = F.lit(1) + F.pmod(F.lit(dow) - F.dayofweek(first), F.lit(7)) + 7 * (n - 1)
    last = F.day(F.last_day(c(ts)))
    return F.when(day > last, day - 7).otherwise(day).cast("int") if n == 5 else day.cast("int")


def holds_sequence(a: Column, b: Column) -> Column:
    """Whether array b occurs in array a without gaps."""
    n = F.size(b)
    return F.when(F.size(a) < n, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(F.size(a) - n + 1, F.lit(1))), lambda i: F.slice(a, i, n) == b))


def breaks_restriction(path: Column, via: Column) -> Column:
    """Whether the last edges of a path are the via list."""
    n = F.size(via)
    return F.when(F.size(path) < n, F.lit(False)).otherwise(F.slice(path, F.greatest(F.size(path) - n + 1, F.lit(1)), n) == via)


def is_closed(breakpoint, speed) -> Column:
    return (c(breakpoint) != 0) & (c(speed) == 0)


def snap_rejects(road_class, toll=None, tunnel=None, bridge=None, ferry=None, min_class: int = 7, max_class: int = 0, exclude_tolls=False, exclude_tunnels=False, exclude_bridges=False, exclude_ferries=False) -> Column:
    out = (c(road_class) > min_class) | (c(road_class) < max_class)
    for flag, on in ((toll, exclude_tolls), (tunnel, exclude_tunnels), (bridge, exclude_bridges), (ferry, exclude_ferries)):
        if on and flag is not None:
            out = out | c(flag)
    return out


def heading_rejects(edge_heading, wanted, tolerance: float) -> Column:
    return F.coalesce(geo.heading_difference(edge_heading, wanted) > tolerance, F.lit(False))


def layer_rejects(edge_layer, wanted) -> Column:
    return F.coalesce(c(edge_layer) != c(wanted), F.lit(False))


def side_rejects(side, mode: str, road_class, cutoff: int, drive_on_right) -> Column:
    """mode: same, opposite or either. Sides of roads above the cutoff class, and unknown sides, are kept."""
    if mode == "either":
        return F.lit(False)
    return (c(side) != "none") & (c(road_class) <= cutoff) & ((c(drive_on_right) == (c(side) == "right")) != F.lit(mode == "same"))


def stops_expanding(transitions, distance, most: int, within: float) -> Column:
    return (c(transitions) > most) & (c(distance) > within)


def trivial(a, b, start, end) -> Column:
    return (c(a) == c(b)) & (c(start) <= c(end))


def freshness(base_fresh, closures_fresh, traffic_fresh) -> Column:
    return F.when(~c(base_fresh) | ~c(closures_fresh), "fail").when(~c(traffic_fresh), "closures only").otherwise("available")


#: Kinds of turn restriction and their numbers.
RESTRICTIONS = {"no_left_turn": 0, "no_right_turn": 1, "no_straight_on": 2, "no_u_turn": 3, "only_right_turn": 4, "only_left_turn": 5, "only_straight_on": 6, "no_entry": 7, "no_exit": 8, "no_turn": 9}
VEHICLES = ("hgv", "emergency", "taxi", "motorcar", "bus", "bicycle", "hazmat", "motorcycle", "foot")


def restriction_kind(value) -> Column:
    """The number of a kind of restriction; null if there is no such kind."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in RESTRICTIONS.items() for x in pair]), c(value))


def qualified(value) -> tuple[Column, Column, Column]:
    """(whether 'kind @ condition' has both parts, kind, condition)"""
    at = F.instr(c(value), "@")
    kind, condition = F.trim(F.substring_index(c(value), "@", 1)), F.trim(F.regexp_replace(c(value), "^[^@]*@", ""))
    return F.coalesce((at > 1) & (F.length(kind) > 0) & (F.length(condition) > 0), F.lit(False)), kind, condition


def restriction_tags(tags: Column) -> tuple[Column, Column]:
    """(whether a relation's tags are usable, the tags as the graph build reads them) of a map of tags.

    Kinds become numbers; of a vehicle's own restriction and the general one the first counts and the other goes; a probable one
    goes beside another; of conditional and probable ones the condition stays. Relations without a restriction are usable as they are.
    """
    own = {v: restriction_kind(tags[f"restriction:{v}"]) for v in VEHICLES}
    kind, cond, prob = tags["type"], tags["restriction:conditional"], tags["restriction:probable"]
    prob = F.when(tags["restriction"].isNull() & cond.isNull(), prob)
    cond_ok, cond_kind, cond_rest = qualified(cond)
    prob_ok, prob_kind, prob_rest = qualified(prob)
    general = F.coalesce(restriction_kind(tags["restriction"]), F.when(cond_ok, restriction_kind(cond_kind)), F.when(prob_ok, restriction_kind(prob_kind)))
    special = F.coalesce(*own.values())
    names = ["restriction", "restriction:conditional", "restriction:probable", *[f"restriction:{v}" for v in VEHICLES]]
    any_tag = F.exists(F.map_keys(tags), lambda k: k.isin(names))
    usable = kind.isin("restriction", "route") & ((kind == "restriction") | tags["restriction:conditional"].isNotNull() | tags["restriction:probable"].isNotNull())
    usable = usable & F.coalesce(special, general).isNotNull() & (cond.isNull() | cond_ok) & (prob.isNull() | prob_ok)
    new = F.array(
        F.struct(F.lit("restriction").alias("key"), F.when(special.isNull(), general).cast("string").alias("value")),
        F.struct(F.lit("restriction:conditional").alias("key"), F.when(cond.isNotNull(), cond_rest).alias("value")),
        F.struct(F.lit("restriction:probable").alias("key"), F.when(prob.isNotNull(), prob_rest).alias("value")),
        *[F.struct(F.lit(f"restriction:{v}").alias("key"), k.cast("string").alias("value")) for v, k in own.items()],
    )
    rest = F.map_filter(tags, lambda k, v: ~k.isin(names))
    made = F.map_concat(rest, F.map_from_entries(F.filter(new, lambda x: x["value"].isNotNull())))
    ok = F.when(any_tag, F.coalesce(usable, F.lit(False))).otherwise(F.lit(True))
    return ok, F.when(any_tag & ok, made).otherwise(tags)


def bridging_restricted(forward: Column, backward: Column, banned: Column, patch: int = 10) -> Column:
    """Whether a banned sequence of edges lies across the place where two searches meet, or an edge is driven twice.

    forward: edges up to the meeting edge, in order; backward: those after it; banned: an array of such arrays. Only `patch` edges
    before the meeting edge and 2 * patch after it are looked at.
    """
    before = F.slice(forward, F.greatest(F.size(forward) - patch, F.lit(1)), patch + 1)
    after = F.slice(backward, 1, 2 * patch + 1)
    path = F.concat(before, after)
    return F.exists(banned, lambda b: holds_sequence(path, b)) | F.arrays_overlap(before, after)


def restriction_view(edges, restrictions, modes: int):
    """edges (edge_id) with the restrictions (from_edge, to_edge, modes) that end at them, forward, or begin at them, reverse, for any of the modes."""
    own = restrictions.where(F.col("modes").bitwiseAND(F.lit(modes).cast("int")) != 0)
    ends = own.withColumn("edge_id", F.col("to_edge")).withColumn("direction", F.lit("forward"))
    return edges.join(ends.unionByName(own.withColumn("edge_id", F.col("from_edge")).withColumn("direction", F.lit("reverse"))), "edge_id")
