"""Trip legs: maneuvers from the edges of a path, directions and written instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.geo import c

#: Upper bounds of a heading in whole degrees, and its name.
CARDINAL = [(23, "north"), (66, "northeast"), (113, "east"), (156, "southeast"), (203, "south"), (246, "southwest"), (293, "west"), (336, "northwest"), (360, "north")]
PHRASES = {
    "start": "Drive <DIRECTION> on <STREET>.", "keep straight": "Continue on <STREET> for <LENGTH>.", "right": "Turn right onto <STREET>.",
    "left": "Turn left onto <STREET>.", "reverse": "Make a U-turn onto <STREET>.", "arrive": "You have arrived at your destination.",
}


def relative_direction(degree) -> Column:
    g = c(degree)
    return F.when((g <= 29) | (g >= 331), "keep straight").when(g <= 159, "right").when(g <= 200, "reverse").otherwise("left")


def cardinal(heading) -> Column:
    out = F.when(c(heading) <= CARDINAL[0][0], CARDINAL[0][1])
    for most, name in CARDINAL[1:]:
        out = out.when(c(heading) <= most, name)
    return out


def maneuvers(rows: DataFrame) -> DataFrame:
    """Edges of paths (query_id, seq, street, length_m) as maneuvers: runs of one street, with their first place and metres."""
    w = Window.partitionBy("query_id").orderBy("seq")
    new = F.when(F.lag("street").over(w).eqNullSafe(F.col("street")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = rows.withColumn("_n", new).withColumn("maneuver", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("query_id", "maneuver").agg(F.min_by("street", "seq").alias("street"), F.min("seq").alias("seq"), F.sum("length_m").cast("long").alias("meters"))


def instruction(kind, street, direction, meters) -> Column:
    """The written instruction of a maneuver; an unknown kind has none."""
    phrase = F.create_map(*[F.lit(x) for k, v in PHRASES.items() for x in (k, v)])[c(kind)]
    return scalar.fill(phrase, direction=direction, street=street, length=scalar.length_phrase(meters))


def active_lanes(lanes: Column, wanted: str) -> Column:
    """array<string> of lanes as 'active' if they allow the wanted direction, else 'invalid'."""
    return F.transform(lanes, lambda x: F.when(F.array_contains(F.split(x, ";"), wanted), "active").otherwise("invalid"))


def sign_text(signs: Column, most: int = 4, between: str = "/") -> Column:
    return F.array_join(F.slice(signs, 1, most), between)
