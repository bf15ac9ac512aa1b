"""Coordinates: boxes, regions, cells, blocks, distances, Mercator tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, MERCATOR_R = 6371.0, 6378137.0
#: Boxes as (west, south, east, north), both ends included.
REGIONS = {"asia": (25.0, -10.0, 180.0, 80.0), "us": (-125.0, 24.0, -66.0, 50.0)}
CELL_DEG, BLOCK_DEG = 0.05, 5.0


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north)


def region_of(lon: Column, lat: Column, regions: dict = REGIONS) -> Column:
    """The first box that holds the point, else `other`."""
    out = F.lit("other")
    for name, box in reversed(list(regions.items())):
        out = F.when(in_box(lon, lat, box), F.lit(name)).otherwise(out)
    return out


def cell_id(x: Column, size: float = CELL_DEG) -> Column:
    """The nearest cell, half to even."""
    return F.rint(x / F.lit(size)).cast("long")


def block_id(lon: Column, lat: Column, size: float = BLOCK_DEG) -> Column:
    return (F.floor(lon / F.lit(size)) * 10_000 + F.floor(lat / F.lit(size))).cast("long")


def pixel(offset: Column, resolution: float) -> Column:
    """Index of the pixel whose centre is nearest, from the distance to the raster's edge."""
    return F.rint(offset / F.lit(resolution) - F.lit(0.5)).cast("int")


def containing(offset: Column, resolution: float) -> Column:
    """Index of the pixel that contains the point."""
    return F.floor(offset / F.lit(resolution)).cast("int")


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def mercator_x(lon: Column) -> Column:
    return F.lit(MERCATOR_R) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(MERCATOR_R) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)).cast("int")


def tile_y(lat: Column, zoom: Column) -> Column:
    share = (F.lit(1.0) - F.ln(F.tan(F.radians(lat)) + F.lit(1.0) / F.cos(F.radians(lat))) / F.lit(math.pi)) / 2
    return F.floor(share * F.pow(F.lit(2.0), zoom)).cast("int")


def axis(index: Column, low: float, resolution: float) -> Column:
    """Centre of a cell of a grid that begins at low: a product, not a running sum."""
    return F.lit(low + resolution / 2) + index * F.lit(resolution)


#: A coarse land outline as boxes (west, south, east, north): land, then sea cut out of it, then land within that sea.
LAND_BOXES = ((25, 5, 145, 78), (68, 6, 92, 35), (95, -10, 142, 7), (129, 30, 146, 46), (117, 4, 127, 20))
SEA_BOXES = (((50, -10, 75, 5), None), ((80, 0, 95, 18), (88, 20, 93, 27)), ((108, 5, 120, 22), (109, 18, 117, 22)))


def coarse_land(lon: Column, lat: Column) -> Column:
    out = F.lit(False)
    for box in LAND_BOXES:
        out = out | in_box(lon, lat, box)
    for sea, kept in SEA_BOXES:
        wet = in_box(lon, lat, sea)
        out = out & ~(wet if kept is None else wet & ~in_box(lon, lat, kept))
    return out


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies within a ring, by the parity of crossings of a ray to the right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            straddles = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
            meets = (y - F.lit(float(y1))) * F.lit((x2 - x1) / (y2 - y1)) + F.lit(float(x1))
            crossings = crossings + F.when(straddles & (x < meets), 1).otherwise(0)
    return crossings % 2 == 1
