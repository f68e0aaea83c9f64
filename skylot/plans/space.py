"""Queries over places: distances, grids, projections, noise."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.functions.scalars import EARTH_M, enu, grid_cell, haversine_m, noise_db, q6
from skylot.operators import ranking
from skylot.plans.twins import q6 as q
from skylot.plans.twins import with_site
from skylot.registry import query
from skylot.sources.lens import sites, stations
from skylot.sources.staging import staged

_M = ("2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, sin(radians({1} - {3}) / 2) * sin(radians({1} - {3}) / 2) + cos(radians({3})) * cos(radians({1})) * sin(radians({0} - {2}) / 2) * sin(radians({0} - {2}) / 2))))")
_DIST = _M.format("s.lon", "s.lat", "t.lon", "t.lat")
_CM = f"CAST(FLOOR({_DIST} * 100 + 5e-1) AS BIGINT)"
RADIUS, CELL = 2000.0, 2500.0


def _cm(metres):
    """Whole centimetres: engines differ in the last bits of sines."""
    return F.floor(metres * 100 + 0.5)


@query("nearest_station", with_site(f"SELECT site_id, arg_min(station_id, ({_CM}, station_id)) AS station_id, min({_CM}) AS cm FROM v_site s CROSS JOIN v_station t GROUP BY site_id"))
def nearest_station(spark, d):
    """Each site's nearest station, by rings of grid cells that grow until the nearest one lies within their reach."""
    return nearest(sites(spark, d), stations(spark, d).withColumnsRenamed({"lon": "lon_t", "lat": "lat_t"}))


def nearest(s, t, size: float | None = None):
    """(site_id, lon, lat) and (station_id, lon_t, lat_t) -> (site_id, station_id, cm). Every ring is an equality join on
    cells of four times the size; a site is done when its best is nearer than the 3 x 3 cells reach at its latitude.
    The first ring's cells hold about one place of stations each, so that a site meets as many whatever the tables' size; of
    stations at one place the first counts. The last ring's cells are as large as all places' span, so that it settles what is left."""
    cm = _cm(haversine_m(F.col("lon_t"), F.col("lat_t"), F.col("lon"), F.col("lat")))
    best = lambda near: near.groupBy("site_id").agg(F.min_by("station_id", F.struct("cm", "station_id")).alias("station_id"), F.min("cm").alias("cm"))
    every = s.select("lon", "lat").union(t.select("lon_t", "lat_t"))
    span = every.agg(F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat"))).first()[0] or 0.0
    t = staged(t.groupBy("lon_t", "lat_t").agg(F.min("station_id").alias("station_id")), "places")
    size = size or max(span / max(1, t.count()) ** 0.5, 1e-4)
    found, left = None, s
    around = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    while True:
        spread = t.select("*", F.inline(around)).select("station_id", "lon_t", "lat_t", (F.floor(F.col("lon_t") / size) + F.col("dx")).alias("cx"), (F.floor(F.col("lat_t") / size) + F.col("dy")).alias("cy"))
        cells = left.withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)})
        near = cells.hint("merge").join(spread, ["cx", "cy"])
        if size <= span:
            reach = F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("lat")) + 2 * size))) * size * 110_000  # metres that a cell is wide at least
            near = near.filter(cm <= _cm(reach))
        done = staged(best(near.select("site_id", "station_id", cm.alias("cm"))), "done")
        found = done if found is None else found.unionByName(done)
        if size > span:
            return found
        left = staged(left.join(done, "site_id", "left_anti"), "left")  # a ring reads what the one before left, not its plan
        if left.isEmpty():
            return found
        size *= 4


def within(s, t, metres: float, parts: int):
    """Pairs of places (lon, lat) and (lon_t, lat_t) that are `metres` apart at most, in whole centimetres, each once where places are: an
    equality join on cells of a part of that distance. Squares of the differences tell most pairs apart, for so near places they are
    right to a thousandth; sines are asked of the rest."""
    size = metres / 111_000 / 0.8 / parts  # so many cells are no narrower than the distance, up to a latitude of 36
    cell = lambda c: F.floor(F.col(c) / size)
    reach = range(-parts, parts + 1)
    around = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in reach for y in reach))
    s = s.withColumns({"cx": cell("lon"), "cy": cell("lat"), "cos_s": F.cos(F.radians("lat"))})
    t = t.withColumn("cos_t", F.cos(F.radians("lat_t"))).select("*", F.inline(around))
    t = t.withColumns({"cx": cell("lon_t") + F.col("dx"), "cy": cell("lat_t") + F.col("dy")}).drop("dx", "dy")
    dx, dy = F.col("lon") - F.col("lon_t"), F.col("lat") - F.col("lat_t")
    square = dy * dy + F.col("cos_s") * F.col("cos_t") * dx * dx
    limit = lambda share: F.lit(math.degrees(metres * share / EARTH_M) ** 2)
    fits = F.when(square < limit(0.998), True).when(square > limit(1.002), False).otherwise(
        _cm(haversine_m(F.col("lon_t"), F.col("lat_t"), F.col("lon"), F.col("lat"))) <= metres * 100)
    return s.hint("merge").join(t, ["cx", "cy"]).filter(fits).drop("cx", "cy", "cos_s", "cos_t")


@query("radius_impact", with_site(f"SELECT station_id, count(DISTINCT site_id) AS n_affected FROM v_site s JOIN v_station t ON {_CM} <= {int(RADIUS * 100)} GROUP BY station_id"))
def radius_impact(spark, d):
    """Sites within a radius of each station: each of them is met once, so that pairs are counted where they are made."""
    t = stations(spark, d).withColumnsRenamed({"lon": "lon_t", "lat": "lat_t"}).distinct()
    return within(sites(spark, d).distinct(), t, RADIUS, 2).groupBy("station_id").agg(F.count(F.lit(1)).alias("n_affected"))


@query("grid_cells", with_site("SELECT CAST(FLOOR(lon * 111000 / 5000) AS BIGINT) AS ix, CAST(FLOOR(lat * 111000 / 5000) AS BIGINT) AS iy, count(*) AS n FROM v_site GROUP BY 1, 2"))
def grid_cells(spark, d):
    ix, iy = grid_cell(F.col("lon") * 111000, F.col("lat") * 111000, 5000)
    return sites(spark, d).groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("n"))


@query("enu_projection", with_site("SELECT site_id, CAST(FLOOR((lon - 114.0) * 111000 * cos(radians(22.5)) * 1000 + 5e-1) AS BIGINT) AS east_mm, CAST(FLOOR((lat - 22.5) * 111000 * 1000 + 5e-1) AS BIGINT) AS north_mm FROM v_site"))
def enu_projection(spark, d):
    east, north = enu(F.col("lon"), F.col("lat"), F.lit(114.0), F.lit(22.5))
    return sites(spark, d).select("site_id", F.floor(east * 1000 + 0.5).alias("east_mm"), F.floor(north * 1000 + 0.5).alias("north_mm"))


_NOISE = "CASE WHEN d <= 0 THEN 75.0 ELSE greatest(0.0, 75.0 - CASE WHEN d > 1 THEN 18 * log10(greatest(d, 1.0)) ELSE 0 END - 0.001 * d - 0.3 * d * greatest(0.0, 1 - h / 150.0) - CASE WHEN h >= 120 THEN 8 WHEN h >= 90 THEN 6 WHEN h >= 60 THEN 4 WHEN h >= 30 THEN 2 ELSE 0 END) END"


@query("noise_level", with_site(f"SELECT site_id, CAST(FLOOR({_NOISE} * 1e4 + 5e-1) AS BIGINT) AS level FROM (SELECT site_id, CAST(site_id % 300 AS DOUBLE) AS d, CAST(site_id % 160 AS DOUBLE) AS h FROM v_site)"))
def noise_level(spark, d):
    level = noise_db((F.col("site_id") % 300).cast("double"), (F.col("site_id") % 160).cast("double"))
    return sites(spark, d).select("site_id", F.floor(level * 1e4 + 0.5).alias("level"))


FLIGHT = 10_000.0
_PAIRS = f"SELECT t.station_id AS i, s.station_id AS j, {_CM} AS cm FROM v_station t JOIN v_station s ON t.station_id < s.station_id AND {_CM} <= {int(FLIGHT * 100)}"


@query("unordered_pairs", with_site(_PAIRS))
def unordered_pairs(spark, d):
    """Distances between stations within a flight's reach of each other, each pair once: an equality join on grid cells.
    Pairs beyond it aren't made: their number is the square of the stations'."""
    t = stations(spark, d).withColumnsRenamed({"station_id": "i", "lon": "lon_t", "lat": "lat_t"})
    cm = _cm(haversine_m(F.col("lon_t"), F.col("lat_t"), F.col("lon"), F.col("lat")))
    return within(stations(spark, d).withColumnRenamed("station_id", "j"), t, FLIGHT, 4).filter("i < j").select("i", "j", cm.alias("cm"))


@query("dense_cells", with_site("SELECT CAST(FLOOR(lon * 20) AS BIGINT) AS ix, CAST(FLOOR(lat * 20) AS BIGINT) AS iy, CAST(row_number() OVER (ORDER BY count(*) DESC, FLOOR(lon * 20), FLOOR(lat * 20)) AS BIGINT) AS place, count(*) AS n FROM v_site GROUP BY FLOOR(lon * 20), FLOOR(lat * 20)"))
def dense_cells(spark, d):
    cells = sites(spark, d).groupBy(F.floor(F.col("lon") * 20).alias("ix"), F.floor(F.col("lat") * 20).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    return ranking.globally_ranked(cells, F.struct(-F.col("n"), F.floor(F.col("ix") / 8)), ("-n", "ix", "iy")).select("ix", "iy", "place", "n")


@query("fleet_round_robin", with_site("SELECT station_id, count(*) AS drones FROM (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS r, count(*) OVER () AS n FROM v_station) JOIN range(250) f(i) ON f.i % n = r GROUP BY station_id"))
def fleet_round_robin(spark, d):
    """A fleet of 250 dealt to the stations in turn."""
    t = stations(spark, d)
    n = t.count()
    first = t.orderBy("station_id").limit(250)  # no more of them get a drone
    placed = first.select("station_id", (F.row_number().over(Window.orderBy("station_id")) - 1).cast("long").alias("r"))
    fleet = spark.range(250).select((F.col("id") % n).alias("r"))
    return fleet.join(placed, "r").groupBy("station_id").agg(F.count(F.lit(1)).alias("drones"))


@query("station_centroid", with_site(f"SELECT {q('avg(lon)')} AS lon, {q('avg(lat)')} AS lat, count(*) AS n FROM v_station"))
def station_centroid(spark, d):
    return stations(spark, d).agg(q6(F.avg("lon")).alias("lon"), q6(F.avg("lat")).alias("lat"), F.count(F.lit(1)).alias("n"))
