"""Portable rounding, window labels and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, DEGREE_M = 6_371_000.0, 111_000.0


def q6(x: Column) -> Column:
    """Half up at six places, by floor alone: engines agree on it, which they don't on round()."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def clock(minutes: Column) -> Column:
    """Minutes of the day as HH:MM; the end of the day is 24:00."""
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def window_label(ts: Column, width: int = 5) -> Column:
    """YYYY-MM-DDTHH:MM-HH:MM of the window of that many minutes, counted from midnight."""
    start = (F.floor(minute_of_day(ts) / width) * width).cast("int")
    return F.concat(F.substring(ts.cast("string"), 1, 10), F.lit("T"), clock(start), F.lit("-"), clock(F.least(start + width, F.lit(1440))))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def noise_db(distance: Column, height: Column, source_db: float = 75.0, absorption: float = 0.3) -> Column:
    """What is left of a flight's noise at a distance, spread, absorbed by the air and by the ground (higher flights lose
    less to it), and less by a step of the height; at no distance all of it."""
    d = distance
    spread = F.when(d > 1, 18 * F.log10(F.greatest(d, F.lit(1.0)))).otherwise(0.0)
    ground = F.lit(absorption) * d * F.greatest(F.lit(0.0), 1 - height / 150)
    step = F.when(height >= 120, 8).when(height >= 90, 6).when(height >= 60, 4).when(height >= 30, 2).otherwise(0)
    left = F.greatest(F.lit(0.0), F.lit(source_db) - spread - 0.001 * d - ground - step)
    return F.when(d <= 0, F.lit(source_db)).otherwise(left)


def enu(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of a reference point."""
    return (lon - lon0) * F.lit(DEGREE_M) * F.cos(F.radians(lat0)), (lat - lat0) * F.lit(DEGREE_M)


def grid_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size), F.floor(y / size)


