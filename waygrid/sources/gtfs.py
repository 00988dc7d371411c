"""GTFS feeds: one typed table for each file, integrity checks, the service calendar as a bit mask, pairs of consecutive stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import c

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
#: Columns that a file must have, then those that it may have.
FILES = {
    "agency": ("agency_id agency_name agency_url agency_timezone", ""), "stops": ("stop_id stop_name stop_lat stop_lon", "location_type parent_station wheelchair_boarding platform_code"),
    "routes": ("route_id route_type", "agency_id route_short_name route_long_name route_desc route_color route_text_color"),
    "trips": ("route_id service_id trip_id", "trip_headsign direction_id block_id shape_id wheelchair_accessible bikes_allowed"),
    "stop_times": ("trip_id arrival_time departure_time stop_id stop_sequence", "shape_dist_traveled"), "calendar": (f"service_id {' '.join(DAYS)} start_date end_date", ""),
    "calendar_dates": ("service_id date exception_type", ""), "frequencies": ("trip_id start_time end_time headway_secs", "exact_times"),
    "shapes": ("shape_id shape_pt_lat shape_pt_lon shape_pt_sequence", "shape_dist_traveled"), "transfers": ("from_stop_id to_stop_id transfer_type", "min_transfer_time"),
}
REQUIRED = ("agency", "stops", "routes", "trips", "stop_times")
TYPES = {"stop_lat": "double", "stop_lon": "double", "shape_pt_lat": "double", "shape_pt_lon": "double", "shape_dist_traveled": "double"} | dict.fromkeys(
    ["location_type", "wheelchair_boarding", "route_type", "direction_id", "wheelchair_accessible", "bikes_allowed", "stop_sequence", "exception_type", "headway_secs", "exact_times", "shape_pt_sequence", "transfer_type", "min_transfer_time", *DAYS], "int")


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The feed's tables. A missing required file or column is an error; other missing ones are empty tables or null columns."""
    out = {}
    for name, (must, may) in FILES.items():
        try:
            raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(f"{folder}/{name}.txt")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) or name in REQUIRED:
                raise
            raw = spark.createDataFrame([], ", ".join(f"`{x}` string" for x in must.split()))
        if lost := [x for x in must.split() if x not in raw.columns]:
            raise ValueError(f"{name}.txt lacks {', '.join(lost)}")
        value = lambda x, raw=raw: (F.trim(raw[x]) if x in raw.columns else F.lit(None)).cast(TYPES.get(x, "string")).alias(x)
        out[name] = raw.select(*[value(x) for x in f"{must} {may}".split()])
    return out


def clock_seconds(text) -> Column:
    """Seconds of HH:MM:SS with hours to 36; null for other texts."""
    part = lambda k: F.regexp_extract(c(text), r"^(\d{1,2}):([0-5]\d):([0-5]\d)$", k).try_cast("int")
    return F.when(part(1) <= 36, part(1) * 3600 + part(2) * 60 + part(3))


def broken_references(feed: dict[str, DataFrame]) -> DataFrame:
    """(file, field, value) of keys that point at nothing."""
    links = [("trips", "route_id", "routes", "route_id"), ("stop_times", "trip_id", "trips", "trip_id"), ("stop_times", "stop_id", "stops", "stop_id"), ("frequencies", "trip_id", "trips", "trip_id"), ("transfers", "from_stop_id", "stops", "stop_id"), ("transfers", "to_stop_id", "stops", "stop_id")]
    out = None
    for a, x, b, y in links:
        lost = feed[a].select(F.col(x).alias("value")).where("value is not null").join(feed[b].select(F.col(y).alias("value")), "value", "left_anti").distinct()
        lost = lost.select(F.lit(a).alias("file"), F.lit(x).alias("field"), "value")
        out = lost if out is None else out.unionAll(lost)
    return out


def service_bits(calendar: DataFrame, exceptions: DataFrame, first_day, days: int = 60) -> DataFrame:
    """(service_id, days long): bit k is set if the service runs k days after first_day.

    calendar: service_id, monday..sunday 0/1, start_date, end_date; exceptions: service_id, date, exception_type (1 added, 2
    removed), which decide over the calendar. A service that never runs has no bits; services of exceptions alone count.
    """
    start, k = F.lit(first_day).cast("date"), F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    runs = F.element_at(F.array(*[F.col(x) for x in [DAYS[6], *DAYS[:6]]]), F.dayofweek("d")) == 1
    each = calendar.withColumn("k", k).withColumn("d", F.date_add(start, F.col("k")))
    regular = each.where(runs & F.col("d").between(F.col("start_date"), F.col("end_date"))).select("service_id", "k")
    own = exceptions.select("service_id", F.datediff("date", start).alias("k"), "exception_type").where(F.col("k").between(0, days - 1))
    left = regular.join(own.where("exception_type = 2").select("service_id", "k"), ["service_id", "k"], "left_anti")
    every = left.union(own.where("exception_type = 1").select("service_id", "k")).distinct()
    bits = every.groupBy("service_id").agg(F.sum(F.expr("shiftleft(1L, k)")).alias("days"))
    ids = calendar.select("service_id").union(exceptions.select("service_id")).distinct()
    return ids.join(bits, "service_id", "left").select("service_id", F.coalesce("days", F.lit(0).cast("long")).alias("days"))


def calendar_table(feed: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    day = lambda x: F.to_date(x, "yyyyMMdd")
    return feed["calendar"].withColumn("start_date", day("start_date")).withColumn("end_date", day("end_date")), feed["calendar_dates"].withColumn("date", day("date"))


def departures(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Each stop of a trip with the next one: trip, route, service, both stops, leaving and arriving seconds. Last stops have none."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    pairs = stop_times.withColumn("to_stop", F.lead("stop_id").over(w)).withColumn("arrives", F.lead(clock_seconds("arrival_time")).over(w)).where("to_stop is not null")
    return pairs.join(trips.select("trip_id", "route_id", "service_id"), "trip_id").select("trip_id", "route_id", "service_id", "stop_sequence", F.col("stop_id").alias("from_stop"), "to_stop", clock_seconds("departure_time").alias("departs"), "arrives")
