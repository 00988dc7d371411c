"""Packed keys of the graph: ids of tile, level and index; live-traffic records; time domains; decoders of small fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c

#: Widths of a graph id's fields in bits: level, tile, index.
LEVEL_BITS, TILE_BITS, INDEX_BITS = 3, 22, 21
INVALID_ID = (1 << 46) - 1


def bits(x, at: int, width: int) -> Column:
    """`width` bits of x from bit `at` on, as a number."""
    return F.shiftrightunsigned(c(x), at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def graph_id(tile, level, index) -> Column:
    return c(level).cast("long").bitwiseOR(F.shiftleft(c(tile).cast("long"), LEVEL_BITS)).bitwiseOR(F.shiftleft(c(index).cast("long"), LEVEL_BITS + TILE_BITS))


def unpack(gid) -> dict[str, Column]:
    return {"level": bits(gid, 0, LEVEL_BITS), "tile": bits(gid, LEVEL_BITS, TILE_BITS), "idx": bits(gid, LEVEL_BITS + TILE_BITS, INDEX_BITS)}


def tile_base(gid) -> Column:
    """The id of the tile alone."""
    return bits(gid, 0, LEVEL_BITS + TILE_BITS)


def format_id(gid) -> Column:
    """level/tile/index"""
    u = unpack(gid)
    return F.concat_ws("/", u["level"].cast("string"), u["tile"].cast("string"), u["idx"].cast("string"))


def parse_id(text) -> Column:
    """Of level/tile/index; null for other texts."""
    p = [F.try_element_at(F.split(c(text), "/"), F.lit(k)).try_cast("long") for k in (1, 2, 3)]
    return F.when(c(text).rlike(r"^\d+/\d+/\d+$"), graph_id(p[1], p[0], p[2]))


def tile_path(tile, level, digits: int = 9) -> Column:
    """level/ddd/ddd/ddd: the tile number with leading zeros in groups of three."""
    padded = F.lpad(c(tile).cast("string"), digits, "0")
    return F.concat_ws("/", c(level).cast("string"), *[F.substring(padded, 1 + 3 * k, 3) for k in range(digits // 3)])


def level_of_class(road_class) -> Column:
    """Motorway to primary (0..2): 0, secondary and tertiary (3, 4): 1, others: 2."""
    return F.when(c(road_class) <= 2, 0).when(c(road_class) <= 4, 1).otherwise(2)


def slope(raw, down: bool = False) -> Column:
    """Of five bits: a value to 15, or with the top bit 16 and four for each step; degrees down are negative."""
    v = F.when(c(raw).bitwiseAND(16) == 0, c(raw)).otherwise(16 + 4 * c(raw).bitwiseAND(15))
    return -v if down else v


def heading8(raw) -> Column:
    """Whole degrees of a heading in eight bits."""
    return F.floor(c(raw) * (360.0 / 255.0) + 0.5).cast("long")


#: Live traffic record: name, first bit, width. Speeds count two km/h; 127 is unknown.
LIVE = [("overall", 0, 7), ("speed1", 7, 7), ("speed2", 14, 7), ("speed3", 21, 7), ("breakpoint1", 28, 8), ("breakpoint2", 36, 8), ("congestion1", 44, 6), ("congestion2", 50, 6), ("congestion3", 56, 6), ("incidents", 62, 1)]


def live_record(raw) -> dict[str, Column]:
    return {name: bits(raw, at, width) for name, at, width in LIVE}


def live_speed(raw_speed) -> Column:
    """km/h of a raw speed, null if unknown."""
    return F.when(c(raw_speed) != 127, c(raw_speed) * 2)


#: Time domain: name, first bit, width.
DOMAIN = [("type", 0, 1), ("dow", 1, 7), ("begin_hrs", 8, 5), ("begin_mins", 13, 6), ("begin_month", 19, 4), ("begin_day_dow", 23, 5), ("begin_week", 28, 3), ("end_hrs", 31, 5), ("end_mins", 36, 6), ("end_month", 42, 4), ("end_day_dow", 46, 5), ("end_week", 51, 3)]


def time_domain(raw) -> dict[str, Column]:
    return {name: bits(raw, at, width) for name, at, width in DOMAIN}


def pack_domain(**fields) -> Column:
    out = F.lit(0).cast("long")
    for name, at, width in DOMAIN:
        if name in fields:
            out = out.bitwiseOR(F.shiftleft(c(fields[name]).cast("long").bitwiseAND(F.lit((1 << width) - 1).cast("long")), at))
    return out


#: Directions of a turn lane, by bit.
LANE_DIRECTIONS = ["reverse", "sharp_left", "left", "slight_left", "merge_to_left", "through", "merge_to_right", "slight_right", "right", "sharp_right"]


def lane_mask(text) -> Column:
    """Bit mask of a lane's directions, written with ; between them; unknown words are no bit."""
    words = F.split(F.lower(c(text)), ";")
    return F.aggregate(words, F.lit(0), lambda m, w: m.bitwiseOR(F.coalesce(F.create_map(*[F.lit(x) for k, d in enumerate(LANE_DIRECTIONS) for x in (d, 1 << k)])[F.trim(w)], F.lit(0))))


def lane_text(mask) -> Column:
    names = F.array(*[F.when(c(mask).bitwiseAND(1 << k) != 0, F.lit(d)) for k, d in enumerate(LANE_DIRECTIONS)])
    return F.array_join(F.array_compact(names), ";")


def hash48(md5_hex) -> Column:
    """The first 48 bits of a hex digest."""
    return F.conv(F.substring(c(md5_hex), 1, 12), 16, 10).cast("long")


def fold16(total) -> Column:
    """Exclusive or of a number's four 16-bit parts."""
    return bits(total, 0, 16).bitwiseXOR(bits(total, 16, 16)).bitwiseXOR(bits(total, 32, 16)).bitwiseXOR(bits(total, 48, 16))
