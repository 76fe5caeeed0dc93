"""Address directory -> district centers -> facility/district distance table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deserta.functions.cleaning import coordinate
from deserta.functions.geo import ETL_RADIUS_KM
from deserta.operators.distance_join import within_distance_join

# Fixed value: distance cap of the facility/district table.
DISTANCE_CAP_KM = 160.0

DISTANCE_COLUMNS = ("unique_id", "name", "address_city", "address_stateOrRegion", "facility_latitude",
                    "facility_longitude", "district", "statename", "center_latitude", "center_longitude",
                    "distance_kilometers", "office_count")

#: Facilities of a grid cell beyond which the distance join divides the cell.
DENSE_CELL = 50_000


def valid_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude",
                      lat_out: str = "latitude_num", lon_out: str = "longitude_num") -> DataFrame:
    """Drop rows whose latitude/longitude is NULL, 'NA', no finite number or out of range (an out-of-range number is
    treated like a malformed one); add the parsed doubles."""
    return (
        df.withColumn(lat_out, coordinate(lat, 90)).withColumn(lon_out, coordinate(lon, 180))
        .filter(F.col(lat_out).isNotNull() & F.col(lon_out).isNotNull())
    )


# Coordinates are averaged as integers at this many units per degree (1e-7 deg, about 1 cm).
COORD_UNITS = 10000000.0


def exact_mean_parts(col: Column, keep: Column | None = None) -> Column:
    """Integer form of a coordinate for an order-independent mean: floor(x * 1e7 + 0.5) (NULL when not kept)."""
    units = F.floor(col * COORD_UNITS + 0.5)
    return units if keep is None else F.when(keep, units)


def exact_mean(sum_col: str, count_col: str) -> Column:
    """sum / count / 1e7 from an integer sum: the same double whatever the partitioning or summation order."""
    return F.col(sum_col).cast("double") / F.col(count_col) / COORD_UNITS


def district_centers(directory: DataFrame) -> DataFrame:
    """A1: centroid and office count per (district, statename) over rows with valid coordinates.

    Validation happens inside the aggregate (conditional sums / count) instead of a filter in front of it: a
    pushed-down filter would parse each coordinate twice. The centroid is summed as integers at 1e-7 degree, so
    it is exact and does not depend on partitioning. Partial aggregation runs before the shuffle, so a district
    holding a large share of all offices costs one partial row per input partition.
    """
    lat, lon = coordinate("latitude", 90), coordinate("longitude", 180)
    parsed = directory.select("district", "statename", lat.alias("_lat"), lon.alias("_lon"))
    ok = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    return (
        parsed.groupBy("district", "statename")
        .agg(F.sum(exact_mean_parts(F.col("_lat"), ok)).alias("_slat"),
             F.sum(exact_mean_parts(F.col("_lon"), ok)).alias("_slon"),
             F.count_if(ok).alias("office_count"))
        .filter(F.col("office_count") > 0)
        .select("district", "statename", exact_mean("_slat", "office_count").alias("center_latitude"),
                exact_mean("_slon", "office_count").alias("center_longitude"), "office_count")
    )


def facility_points(facilities: DataFrame, carry: list[str] | None = None) -> DataFrame:
    return (
        facilities.filter((F.abs("latitude") <= 90) & (F.abs("longitude") <= 180))
        .select("unique_id", "name", "address_city", "address_stateOrRegion",
                F.col("latitude").alias("facility_latitude"), F.col("longitude").alias("facility_longitude"), *(carry or []))
    )


def facility_district_distances(facilities: DataFrame, centers: DataFrame, radius_km: float = DISTANCE_CAP_KM,
                                earth_radius_km: float = ETL_RADIUS_KM, cell_deg: float | None = None,
                                ordered: bool = False, dense_cell: int = DENSE_CELL, carry: list[str] | None = None) -> DataFrame:
    """Every (facility, district) pair within ``radius_km``; optionally sorted by (unique_id, distance). Grid cells of
    more than ``dense_cell`` facilities are split by their counts. ``carry``: further columns of ``facilities`` to keep."""
    out = within_distance_join(
        facility_points(facilities, carry), "facility_latitude", "facility_longitude",
        centers, "center_latitude", "center_longitude",
        radius_km=radius_km, earth_radius_km=earth_radius_km, cell_deg=cell_deg, dense_cell=dense_cell,
    ).select(*DISTANCE_COLUMNS, *(carry or []))
    return out.orderBy("unique_id", "distance_kilometers") if ordered else out
