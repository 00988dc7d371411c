"""Costing models as column expressions over edges, their nodes and the edge before.

Options are plain numbers checked on the driver (Options); what a model computes for an edge or an edge pair is a Column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.geo import c

# Weights by road class, by surface, and the seconds and penalties of transitions.
HIGHWAY_BY_CLASS = [1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
SURFACE = [0.0, 0.0, 0.0, 0.1, 0.2, 0.5, 1.0]
TURN_PENALTY, U_TURN_SECONDS, TURN_BIAS, SIGNAL_SECONDS = 7.5, 20.0, 1.075, 2.0
NAME_INCONSISTENT_U_TURN, UNFAVORABLE_U_TURN, PENCIL_POINT_U_TURN = 10.0, 600.0, 15.0
FLOW_BITS = {"freeflow": 1, "constrained": 2, "predicted": 4, "current": 8}
WEEK_S, DAY_S, DAY_START, DAY_END, FADE_S = 604_800, 86_400, 25_200, 68_400, 3_600


@dataclass(frozen=True)
class Options:
    """Preferences from 0 to 1, speeds in km/h, costs and penalties in seconds. A value out of its range becomes the default."""

    use_highways: float = 0.5
    use_tolls: float = 0.5
    use_ferry: float = 0.5
    use_distance: float = 0.0
    top_speed: float = 140.0
    truck_speed: float = 120.0
    low_class_penalty: float = 30.0
    maneuver_penalty: float = 5.0
    destination_only_penalty: float = 600.0
    alley_penalty: float = 5.0
    gate_cost: float = 30.0
    gate_penalty: float = 300.0
    toll_booth_cost: float = 15.0
    toll_booth_penalty: float = 0.0
    country_crossing_cost: float = 600.0
    country_crossing_penalty: float = 0.0
    ferry_cost: float = 300.0
    service_penalty: float = 15.0
    closure_factor: float = 9.0
    speed_penalty_factor: float = 0.05
    flow_mask: int = 15
    changed: tuple = field(default=(), compare=False)


RANGES = {"use_highways": (0, 1), "use_tolls": (0, 1), "use_ferry": (0, 1), "use_distance": (0, 1), "top_speed": (10, 252), "truck_speed": (10, 252), "closure_factor": (1, 10)}


def parse(given: dict) -> Options:
    """Options of a request; unknown names are ignored, values outside their range replaced by the default and named in `changed`."""
    known, changed = {}, []
    for name, value in given.items():
        if name == "speed_types":
            known["flow_mask"] = sum(FLOW_BITS.get(x, 0) for x in set(value))
        elif name in Options.__dataclass_fields__ and name != "changed":
            low, high = RANGES.get(name, (0, 43_200))
            if low <= value <= high:
                known[name] = value
            else:
                changed.append(name)
    return Options(**known, changed=tuple(changed))


def highway_factor(o: Options) -> float:
    return (0.5 - o.use_highways) ** 3 if o.use_highways >= 0.5 else 8.0 * (1 - 2 * o.use_highways) ** 2


def toll_factor(o: Options) -> float:
    return 4.0 - 8.0 * o.use_tolls if o.use_tolls < 0.5 else (0.5 - o.use_tolls) * 0.03


def ferry(o: Options) -> tuple[float, float]:
    """(factor, penalty)"""
    return (10.0 - 18.0 * o.use_ferry, float(int(21_600 * (1 - 2 * o.use_ferry)))) if o.use_ferry < 0.5 else (1.5 - o.use_ferry, 0.0)


def pick(values: list[float], index) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), c(index).cast("int") + 1)


def edge_speed(default, free, constrained, predicted, live, live_share, second, from_now, mask: int = 15) -> Column:
    """The speed an edge is driven at, in whole km/h.

    Live speed counts by the share of the edge that has one and fades over an hour; the rest is predicted, else constrained by
    day, else free flow by night (or without a time), else the default. Null speeds and a null second (no time) are unknown.
    """
    day = (F.pmod(c(second), F.lit(DAY_S)) > DAY_START) & (F.pmod(c(second), F.lit(DAY_S)) < DAY_END)
    no_time, has = c(second).isNull(), lambda x, bit: c(x).isNotNull() & (c(x) >= 1) & F.lit(bool(mask & bit))
    share = F.when(c(live).isNotNull() & ~no_time & F.lit(bool(mask & 8)), c(live_share) * (F.lit(1.0) - F.least(c(from_now) / float(FADE_S), F.lit(1.0)))).otherwise(F.lit(0.0))
    base = (
        F.when(c(predicted).isNotNull() & ~no_time & F.lit(bool(mask & 4)), F.greatest(c(predicted), F.lit(0.5)) + 0.5)
        .when(has(constrained, 2) & (no_time | day), c(constrained)).when(has(free, 1) & (no_time | ~day), c(free)).otherwise(c(default))
    )
    return F.floor(F.coalesce(c(live), F.lit(0)) * share + (F.lit(1.0) - share) * base).cast("long")


def seconds(length, speed, top: float) -> Column:
    return c(length) * scalar.speed_factor(F.least(c(speed), F.lit(top)))


def speed_penalty(average, top: float, factor: float) -> Column:
    return F.greatest(F.lit(0.0), c(average) - top) * factor


def auto_cost(length, speed, road_class, density, toll, surface=None, closed=None, o: Options = Options()) -> tuple[Column, Column]:
    """(cost, seconds) of driving a whole edge."""
    secs = seconds(length, speed, o.top_speed)
    factor = scalar.density_factor(density) + highway_factor(o) * pick(HIGHWAY_BY_CLASS, road_class) + speed_penalty(speed, o.top_speed, o.speed_penalty_factor) + c(toll) * toll_factor(o)
    if surface is not None:
        factor = factor + 0.5 * pick(SURFACE, surface)
    if closed is not None:
        factor = factor * F.when(c(closed), o.closure_factor).otherwise(1.0)
    return (secs * (1 - o.use_distance) + c(length) * (o.use_distance / 16.0)) * factor, secs


def truck_cost(length, speed, truck_speed, truck_route, toll, o: Options = Options(), non_truck_factor: float = 1.0) -> tuple[Column, Column]:
    secs = seconds(length, F.least(c(speed), F.coalesce(F.nullif(c(truck_speed), F.lit(0)), c(speed)), F.lit(o.truck_speed)), o.top_speed)
    factor = F.when(c(truck_route), F.lit(0.85)).otherwise(F.lit(non_truck_factor)) + c(toll) * toll_factor(o)
    return secs * factor, secs


def taxi_cost(length, speed, density, taxi_only, o: Options = Options()) -> tuple[Column, Column]:
    secs = seconds(length, speed, o.top_speed)
    factor = scalar.density_factor(density) + speed_penalty(speed, o.top_speed, o.speed_penalty_factor)
    return secs * factor * F.when(c(taxi_only), 0.85).otherwise(1.0), secs


def turn_seconds(degree, drive_on_right, roads, signal) -> Column:
    """Of a turn of whole degrees, by a sigmoid that is steeper to the side one drives on."""
    signed = F.when(c(degree) > 180, c(degree) - 360).otherwise(c(degree))
    inverse = 1.0 / TURN_BIAS

    def sigmoid(angle, near: bool):
        a, b = (inverse, TURN_BIAS) if near else (TURN_BIAS, inverse)
        return F.lit(TURN_PENALTY) / (F.lit(1.0) + F.exp(-(F.lit(13.0 * a) * angle / 180.0 - 6.5 * b)))

    right = F.when(signed >= 0, sigmoid(signed, True)).otherwise(sigmoid(-signed, False))
    left = F.when(signed >= 0, sigmoid(signed, False)).otherwise(sigmoid(-signed, True))
    reverse = c(degree).between(160, 200)
    turned = F.when(c(drive_on_right), right).otherwise(left) + F.when(reverse, U_TURN_SECONDS).otherwise(0.0)
    return F.when(c(signal), SIGNAL_SECONDS).otherwise(0.0) + F.when((c(roads) > 2) | reverse, turned).otherwise(0.0)


def u_turn_seconds(base, reverse, name_consistent, pencil_point) -> Column:
    return (
        F.when(c(reverse) & ~c(name_consistent), c(base) + NAME_INCONSISTENT_U_TURN).when(c(reverse), c(base) + UNFAVORABLE_U_TURN)
        .when(c(pencil_point), c(base) * PENCIL_POINT_U_TURN).otherwise(c(base))
    )


def base_transition(node_type, edge: dict, before: dict, o: Options = Options()) -> tuple[Column, Column]:
    """(cost, seconds) of entering an edge: border, gate, toll, ferry (both), destination only, alley, maneuver, service (cost).

    edge and before: toll, use, destination_only; edge also link and same_name. Uses are texts, node types too.
    """
    one = lambda when: F.when(when, 1.0).otherwise(0.0)
    use = lambda kind: one((edge["use"] == kind) & (before["use"] != kind))
    toll = one((c(node_type) == "toll_booth") | (edge["toll"] & ~before["toll"]))
    timed = [(one(c(node_type) == "border"), o.country_crossing_cost, o.country_crossing_penalty), (one(c(node_type) == "gate"), o.gate_cost, o.gate_penalty), (toll, o.toll_booth_cost, o.toll_booth_penalty), (use("ferry"), o.ferry_cost, ferry(o)[1])]
    secs = sum((k * s for k, s, _ in timed), F.lit(0.0))
    cost = sum((k * (s + p) for k, s, p in timed), F.lit(0.0))
    cost = cost + one(edge["destination_only"] & ~before["destination_only"]) * o.destination_only_penalty + use("alley") * o.alley_penalty
    return cost + one(~edge["link"] & ~edge["same_name"]) * o.maneuver_penalty + use("service") * o.service_penalty, secs


#: Fixed values, by kind of turn: straight, slight right, right, sharp right, reverse, sharp left, left, slight left.
RIGHT_SIDE_TURN = [0.5, 0.75, 1.0, 1.5, 9.5, 3.5, 2.5, 0.75]
LEFT_SIDE_TURN = [0.5, 0.75, 2.5, 3.5, 9.5, 1.5, 1.0, 0.75]
CROSSING_TURN, RAMP_TURN, ROUNDABOUT_TURN, LOW_CLASS_SECONDS, LEFT_SPEED = 2.0, 1.5, 0.5, 30.0, 13.4
TURNS = ("straight", "slight right", "right", "sharp right", "reverse", "sharp left", "left", "slight left")


def intersection_cost(turn, impact, crossing, drive_on_right, ramp, ramp_before, roundabout, density, measured, name_consistent, pencil_point) -> Column:
    """Cost of passing a node from one edge into another, besides the base cost: by the side one drives on, times the stop impact and
    the density. turn: one of TURNS; impact 0..7, 0 costs nothing; measured: the edge before has live speed, so only turns count."""
    side = lambda costs: F.element_at(F.create_map(*[F.lit(x) for pair in zip(TURNS, costs, strict=True) for x in pair]), c(turn))
    base = F.when(c(crossing), F.lit(CROSSING_TURN)).when(c(drive_on_right), side(RIGHT_SIDE_TURN)).otherwise(side(LEFT_SIDE_TURN))
    onto = c(ramp) != c(ramp_before)
    base = base + F.when(onto, F.lit(RAMP_TURN) + F.when(c(roundabout), F.lit(ROUNDABOUT_TURN)).otherwise(0.0)).otherwise(0.0)
    turned = c(turn).isin("left", "sharp left", "right", "sharp right", "reverse")
    secs = u_turn_seconds(F.when(turned, base * c(impact)).otherwise(base), c(turn) == "reverse", name_consistent, pencil_point)
    secs = F.when(c(measured), secs).otherwise(F.when(turned, secs).otherwise(secs * c(impact)) * scalar.transition_density(density))
    return F.when(c(impact) > 0, secs).otherwise(0.0)


def unprotected_left(turn, signal, detour_m: float) -> Column:
    """Cost of a left turn without a signal, worth a detour of so many metres; none at 0."""
    return F.when(c(turn).isin("left", "sharp left") & ~c(signal) & F.lit(detour_m > 0), F.lit(detour_m / LEFT_SPEED)).otherwise(0.0)


def truck_entry(road_class, truck_access, truck_access_before, no_access_penalty: float = 0.0, static_friction: bool = True) -> Column:
    """A truck's cost of entering a residential or service road (class 6 or 7), and an edge that is closed to it from one that is not."""
    low = F.when((c(road_class) >= 6) & F.lit(static_friction), F.lit(LOW_CLASS_SECONDS)).otherwise(0.0)
    return low + F.when(c(truck_access_before) & ~c(truck_access), F.lit(no_access_penalty)).otherwise(0.0)


def partial(cost, secs, start, end) -> tuple[Column, Column]:
    """Of the part of an edge between two shares of its length."""
    share = F.greatest(F.lit(0.0), c(end) - c(start))
    return c(cost) * share, c(secs) * share


def beeline_seconds(meters, top: float, factor: float = 1.0) -> Column:
    return c(meters) * 3.6 / top * factor


REGISTRY = {"auto": auto_cost, "truck": truck_cost, "taxi": taxi_cost, "bus": auto_cost}


def register(name: str, model) -> None:
    """Adds a costing model: a function that gives (cost, seconds)."""
    REGISTRY[name] = model
