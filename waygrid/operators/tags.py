"""Map tags as attributes: who may pass a node."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bit of each mode, and the tag values that open a node to it and that close it.
MODES = {"auto": 1, "foot": 2, "bike": 4, "truck": 8, "emergency": 16, "taxi": 32, "bus": 64, "hov": 128, "wheelchair": 256, "moped": 512, "motorcycle": 1024}
ACCESS = ("yes private permissive use_sidepath delivery designated dismount destination customers official public restricted allowed permit residents", "no agricultural discouraged forestry emergency psv")
MOTOR = ("yes private permissive delivery designated destination customers official public restricted allowed permit residents", "no agricultural discouraged forestry")
FOOT = ("yes private permissive use_sidepath delivery designated destination customers official public restricted crossing sidewalk allowed passable footway permit residents", "no agricultural discouraged forestry")
WHEELCHAIR = ("yes designated limited official destination public permissive only private assisted permit residents", "no impassable partial bad half")
BICYCLE = ("yes designated use_sidepath permissive destination dismount lane track shared shared_lane sidepath share_busway allowed private official permit residents", "no none")
TRUCK = ("designated yes destination delivery local private permissive official permit residents", "no agricultural discouraged unsuitable forestry")
MOPED = ("yes designated private permissive destination delivery dismount permit residents", "no unknown agricultural")
MOTORCYCLE = ("yes private permissive delivery designated destination customers official public restricted allowed permit", "no agricultural discouraged forestry")
BUS = TAXI = ("yes designated urban permissive restricted destination official permit", "no delivery")
PSV_BUS, PSV_TAXI = ("bus yes designated permissive 1 2", "no"), ("taxi yes designated permissive 1 2", "no")
GATES = ("gate", "yes", "lift_gate", "swing_gate", "sliding_beam")
BOLLARDS = ("bollard", "block", "kissing_gate", "motorcycle_barrier", "cycle_barrier", "chain", "bar")
WALLS = ("fence", "barrier_board", "wall", "jersey_barrier", "debris")
#: What stays open, of the modes that no tag names, at a node that is open, a bollard or a sump buster; nothing at a wall.
OPEN, PAST_BOLLARD, PAST_SUMP = sum(MODES.values()), 2 + 4 + 256, 8 + 64 + 2 + 4 + 16 + 256 + 512 + 1024


def allowed(value: Column, table: tuple[str, str], bit: int) -> Column:
    """The bit if a value, or one of several between semicolons, opens; 0 if one closes; else null."""
    parts = F.split(value, ";")
    has = lambda words: F.arrays_overlap(parts, F.array(*map(F.lit, words.split())))
    return F.when(has(table[0]), F.lit(bit)).when(has(table[1]), F.lit(0))


def node_access(tags: Column) -> Column:
    """The modes that may pass a node, as bits, of its map of tags."""
    t = lambda k: tags[k]
    eq = lambda k, *v: F.coalesce(t(k).isin(*v), F.lit(False))
    first = allowed(t("access"), ACCESS, 1)
    shut = (F.coalesce(first, F.lit(1)) == 0) | eq("impassable", "yes") | (eq("access", "private") & (eq("emergency", "yes") | eq("service", "emergency_access")))
    motor = allowed(t("motor_vehicle"), MOTOR, 1)
    auto = F.coalesce(allowed(t("motorcar"), MOTOR, 1), motor)
    also = lambda bit: F.when(auto == 1, F.lit(bit)).when(motor == 0, F.lit(0))  # noqa: E731  what cars may do, and what no motor vehicle may
    psv = eq("access", "psv")
    foot = allowed(t("foot"), FOOT, 2)
    bike = allowed(t("bicycle"), BICYCLE, 4)
    own = {
        "auto": auto,
        "foot": foot,
        "bike": F.when((bike == 0) & eq("highway", "crossing"), F.lit(4)).otherwise(bike),
        "truck": F.coalesce(allowed(t("hgv"), TRUCK, 8), also(8)),
        "emergency": F.when(eq("access", "emergency") | eq("emergency", "yes") | eq("service", "emergency_access"), F.lit(16)),
        "taxi": F.coalesce(F.when(psv, F.lit(32)).otherwise(allowed(t("taxi"), TAXI, 32)), allowed(t("psv"), PSV_TAXI, 32), also(32)),
        "bus": F.coalesce(F.when(psv, F.lit(64)).otherwise(allowed(t("bus"), BUS, 64)), allowed(t("psv"), PSV_BUS, 64), also(64)),
        "hov": F.coalesce(F.when((t("hov").isNotNull() & ~eq("hov", "no")) | t("hov:lanes").isNotNull() | t("hov:minimum").isNotNull(), F.lit(128)), also(128)),
        "wheelchair": F.coalesce(allowed(t("wheelchair"), WHEELCHAIR, 256), F.when(foot == 2, F.lit(256))),
        "moped": F.coalesce(allowed(t("moped"), MOPED, 512), allowed(t("mofa"), MOPED, 512), F.when(motor == 0, F.lit(0))),
        "motorcycle": F.coalesce(allowed(t("motorcycle"), MOTORCYCLE, 1024), F.when(motor == 0, F.lit(0))),
    }
    gate = eq("barrier", *GATES)
    post = ~gate & (eq("barrier", *BOLLARDS) | eq("bollard", "removable"))
    rising = post & eq("bollard", "rising")
    gate, post = gate | rising, post & ~rising
    sump, wall = ~gate & eq("barrier", "sump_buster"), ~gate & eq("barrier", *WALLS)
    crossing = eq("highway", "crossing") | eq("railway", "crossing") | eq("footway", "crossing") | eq("cycleway", "crossing") | eq("foot", "crossing") | eq("bicycle", "crossing") | eq("pedestrian", "crossing") | t("crossing").isNotNull()
    crossing = crossing & ~gate & ~post & ~sump & ~wall & ~shut
    closed = shut | eq("vehicle", "no") | eq("smoothness", "impassable") | eq("hov", "designated")
    left = F.when(closed, F.when(shut | eq("hov", "designated"), F.lit(0)).otherwise(F.lit(2))).otherwise(F.lit(OPEN))
    by_car = lambda bit: F.when(closed, F.lit(0)).otherwise(F.coalesce(auto, F.lit(bit)))  # noqa: E731  an open node's taxis and pools go by the cars' own tag
    state = F.when(post & first.isNull(), F.lit(PAST_BOLLARD)).when(sump, F.lit(PAST_SUMP)).when(wall, F.lit(0)).when(crossing, F.lit(OPEN))
    mask = F.lit(0)
    for mode, bit in MODES.items():
        plain = by_car(bit) if mode in ("taxi", "hov") else left.bitwiseAND(bit)
        mask = mask.bitwiseOR(F.coalesce(own[mode], F.coalesce(state.bitwiseAND(bit), plain)))
    return mask.cast("int")
