"""Scalar functions on numbers, tags, times and JSON, as column expressions; null in, null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c

WEEK_S, DAY_S, INT_MAX = 604_800, 86_400, 2_147_483_647


def leading_int(text) -> Column:
    """The whole number that a text begins with, 0 if none."""
    return F.coalesce(F.regexp_extract(c(text), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def leading_float(text) -> Column:
    return F.coalesce(F.regexp_extract(c(text), r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def speed_kph(text) -> Column:
    """Of '50', '50 kph' or '30 mph'; null for other texts."""
    n = F.regexp_extract(c(text), r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(c(text).rlike(r"(?i)mph\s*$"), n * 1.609344).otherwise(n)


def weight_tons(text) -> Column:
    """Tons of '7.5', '7.5 t', '15000 lbs' or '3500 kg'."""
    n, unit = F.regexp_extract(c(text), r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lower(F.regexp_extract(c(text), r"([A-Za-z]+)\s*$", 1))
    return F.when(unit.isin("lb", "lbs"), n / 2000.0).when(unit == "kg", n / 1000.0).when(unit.isin("", "t", "ton", "tons", "tonne", "tonnes"), n)


def measure_meters(text) -> Column:
    """Metres of a sum of parts such as 3.2 m, 320 cm, 10 ft 6 in or 10'6\"; a bare number is metres."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c(text)), "'", "ft "), '"', "in ")
    parts = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?\s*(?:cm|m|ft|in)?)"), F.lit(1))
    unit = lambda p: F.when(p.endswith("cm"), 0.01).when(p.endswith("ft"), 0.3048).when(p.endswith("in"), 0.0254).otherwise(1.0)
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.regexp_extract(p, r"(\d+(?:\.\d+)?)", 1).cast("double") * unit(p)))


def conditional(text) -> tuple[Column, Column]:
    """(value, condition) of 'value @ (condition)'; the condition is null without one."""
    return F.trim(F.regexp_extract(c(text), r"^([^@]*)", 1)), F.nullif(F.regexp_extract(c(text), r"@\s*\(?([^()]*)\)?", 1), F.lit(""))


def tokens(text) -> Column:
    """Parts between semicolons, trimmed; empty ones are none."""
    return F.filter(F.transform(F.split(c(text), ";"), lambda x: F.trim(x)), lambda x: x != "")


def ranged_default(x, low, default, high) -> Column:
    """x if it lies in the range, else the default (not the bound)."""
    return F.when(c(x).between(low, high), c(x)).otherwise(F.lit(default))


def saturating(x) -> Column:
    return F.least(c(x).cast("long"), F.lit(INT_MAX).cast("long"))


def circular(x, low, high) -> Column:
    """x brought into [low, high) by whole ranges."""
    return F.pmod(c(x) - low, F.lit(high - low)) + low


def speed_factor(kph) -> Column:
    """Seconds per metre; an hour's seconds for speed 0."""
    return F.when(c(kph) == 0, F.lit(3600.0)).otherwise(F.lit(3.6) / c(kph))


def travel_seconds(meters, kph) -> Column:
    return F.when(c(kph) == 0, F.lit(0).cast("long")).otherwise(F.floor(c(meters) * 3.6 / c(kph) + 0.5).cast("long"))


#: By density 0..15.
TRANSITION_DENSITY = [1.0, 1.0, 1.0, 1.0, 1.0, 1.1, 1.2, 1.3, 1.4, 1.6, 1.9, 2.2, 2.5, 2.8, 3.1, 3.5]


def density_factor(density) -> Column:
    return F.lit(0.85) + c(density) * 0.025


def transition_density(density) -> Column:
    return F.element_at(F.array(*map(F.lit, TRANSITION_DENSITY)), c(density).cast("int") + 1)


def second_of_week(ts) -> Column:
    """Seconds since Sunday 00:00 of a timestamp in the session's zone."""
    return ((F.dayofweek(c(ts)) - 1) * DAY_S + F.hour(c(ts)) * 3600 + F.minute(c(ts)) * 60 + F.second(c(ts))).cast("long")


def advance_week(second, by) -> Column:
    """Later by whole seconds; only a sum beyond the week's end wraps, so the end itself stays."""
    s = c(second) + c(by)
    return F.when(s > WEEK_S, s - WEEK_S).otherwise(s)


def json_first(doc, *paths: str, kind: str = "string") -> Column:
    """The first of several fields that is there, as a type; what does not fit is null."""
    return F.coalesce(*[F.get_json_object(c(doc), p).try_cast(kind) for p in paths])


def delay_seconds(delay, current, free) -> Column:
    """The stated delay, else how much longer than free flow it takes, 0 at least."""
    return F.coalesce(c(delay), F.greatest(F.lit(0), c(current) - c(free)))


def confidence(x) -> Column:
    """In 0..1; a missing or unfinite one is 0."""
    v = c(x).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def flow_severity(speed, free) -> Column:
    ratio = c(speed) / F.nullif(c(free).cast("double"), F.lit(0.0))
    return F.when(ratio <= 0.5, "heavy").when(ratio < 0.85, "moderate").when(ratio.isNotNull(), "free_flow")


def magnitude_severity(x) -> Column:
    return F.when(c(x) >= 4, "critical").when(c(x) == 3, "major").when(c(x) == 2, "moderate").when(c(x) == 1, "minor").otherwise("unknown")


def unit_speed(value, unit) -> Column:
    """km/h; null for an unknown unit."""
    u = F.lower(c(unit))
    return F.when(u.isin("kph", "km/h", "kmph"), c(value)).when(u == "mph", c(value) * 1.609344).when(u.isin("m/s", "mps"), c(value) * 3.6)


def without_query(url) -> Column:
    return F.regexp_replace(c(url), r"[?#].*$", "")


def route_identity(edge_ids, key=None, fallback="unknown") -> Column:
    """edges: and the ids in 16 hex digits; without edges the key, else the fallback."""
    hexed = F.array_join(F.transform(edge_ids, lambda x: F.lpad(F.hex(x), 16, "0")), ",")
    return F.when(F.size(edge_ids) > 0, F.concat(F.lit("edges:"), hexed)).otherwise(F.coalesce(c(key) if key is not None else F.lit(None).cast("string"), F.lit(fallback)))


#: Longer than any name of the list below it, so that north-east is not read as north.
_DIRECTIONS = "Northeast|Northwest|Southeast|Southwest|North|South|East|West"


def base_name(name) -> Column:
    """A US street name without its leading and trailing direction."""
    return F.trim(F.regexp_replace(F.regexp_replace(c(name), rf"^(?:{_DIRECTIONS})\s+(?=\S)", ""), rf"\s+(?:{_DIRECTIONS})$", ""))


def is_route_number(name) -> Column:
    return c(name).rlike(r"^[A-Z]{1,3}[ -]?\d+")


def word_count(text) -> Column:
    return F.size(F.filter(F.split(F.trim(c(text)), r"\s+"), lambda x: x != "")).cast("long")


def length_phrase(meters) -> Column:
    """Spoken metric length: rounded to 10 m below 100 m, 50 m below 1 km, half km below 10 km, whole km beyond."""
    m = c(meters)
    step = lambda x, s: (F.floor(x / s + 0.5) * s).cast("long")
    half = F.floor(m / 500.0 + 0.5).cast("long")
    return (
        F.when(m < 10, F.lit("less than 10 meters")).when(step(m, 10) < 100, F.concat(step(m, 10).cast("string"), F.lit(" meters")))
        .when(step(m, 50) < 1000, F.concat(step(m, 50).cast("string"), F.lit(" meters")))
        .when(half < 20, F.concat(F.floor(half / 2).cast("string"), F.when(half % 2 == 1, ".5").otherwise(""), F.when(half == 2, " kilometer").otherwise(" kilometers")))
        .otherwise(F.concat(F.floor(m / 1000.0 + 0.5).cast("string"), F.lit(" kilometers")))
    )


def plural(n, locale: str = "en") -> Column:
    """Plural category of a count."""
    x = c(n)
    if locale in ("ru", "uk"):
        return F.when((x % 10 == 1) & (x % 100 != 11), "one").when((x % 10).between(2, 4) & ~(x % 100).between(12, 14), "few").otherwise("many")
    if locale in ("cs", "sk"):
        return F.when(x == 1, "one").when(x.between(2, 4), "few").otherwise("other")
    return F.when(x == 1, "one").otherwise("other")


def fill(phrase, **tags) -> Column:
    """A phrase with its <TAGS> replaced."""
    out = c(phrase)
    for name, value in tags.items():
        out = F.replace(out, F.lit(f"<{name.upper()}>"), c(value).cast("string"))
    return out


def stable_id(text) -> Column:
    """FNV-1a of the text's UTF-8, its low 48 bits; of null, null. Only these bits are kept on the way, so no product overflows."""
    mask, raw = (1 << 48) - 1, F.hex(F.encode(c(text), "utf-8"))
    part = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))

    def step(h, b):
        x = h.bitwiseXOR(b)
        return (x * 0x1B3 + F.shiftleft(x.bitwiseAND(0xFF), 40)).bitwiseAND(mask)

    start = F.lit(0xCBF29CE484222325 & mask).cast("long")
    return F.when(F.length(raw) == 0, start).otherwise(F.aggregate(part, start, step))


def bucket_place(cost, low: float, size: int, span: float) -> Column:
    """The bucket of a two-level queue that a cost waits in: -1 beyond the span, else counted from the start of the bucket of `low`."""
    start = int(low) - int(low) % size
    return F.when(c(cost) >= start + span, F.lit(-1)).when(c(cost) > start, F.floor((c(cost) - start) / size)).otherwise(F.lit(0)).cast("long")
