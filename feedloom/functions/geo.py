"""Places and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def parse_location(text: Column) -> Column:
    """``lat,lon`` in range as a struct, else null."""
    parts = F.split(text, ",")
    lat = F.get(parts, F.lit(0)).try_cast("double")
    lon = F.get(parts, F.lit(1)).try_cast("double")
    fine = (F.size(parts) == 2) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(fine, F.struct(lat.alias("latitude"), lon.alias("longitude")))


def geotag_location(city: Column, country: Column) -> Column:
    """``City, CC``, or the one that is there, else null."""
    some = F.concat_ws(", ", F.nullif(F.trim(city), F.lit("")), F.nullif(F.trim(country), F.lit("")))
    return F.nullif(some, F.lit(""))


def recency_score(created: Column, ingested: Column) -> Column:
    """1 at no age, 0 from 720 hours on; 0 for times ahead, 0.5 for unreadable ones."""
    hours = (F.unix_micros(ingested) - F.unix_micros(created)) / F.lit(3_600_000_000.0)
    return F.when(hours.isNull(), 0.5).when(hours < 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - hours / 720.0))


def standardize_ts(text: Column, run_ts: Column) -> tuple[Column, Column]:
    """(whole seconds in UTC, whether the run's time had to stand in)."""
    parsed = F.try_to_timestamp(text)
    return F.date_trunc("second", F.coalesce(parsed, run_ts)), parsed.isNull()
