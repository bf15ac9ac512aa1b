"""Nearest reference points on the sphere, and attributes taken from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km

#: References up to this number travel to every task as one array; beyond it the search goes by squares of the globe.
MOST_BROADCAST = 2_000
#: Sides of the squares, in degrees; the last one holds everything.
SQUARES = (1.0, 4.0, 15.0, 60.0, 360.0)


def nearest_reference(cells: DataFrame, refs: DataFrame, key: str, ref_key: str, carry: tuple[str, ...] = (), lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Each cell row with the nearest reference's key, distance_km and carried columns; ties go to the smaller key.

    One row in, one row out: rows may repeat, and the cells' key may be NULL. A cell without a position, or without
    any reference, gets NULLs. References without a position or a key take no part.

    The references are counted first: a small table travels to the cells, where the few that may be nearest are
    picked for each row, without a shuffle; a larger one is joined by squares for each different position. Both leave
    the last word to the same distance, and give the same rows.
    """
    slim = refs.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull() & F.col(ref_key).isNotNull()).select(F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"), F.col(ref_key).alias("k"), *[F.col(c).alias(f"c_{c}") for c in carry]).alias("_r"))
    if slim.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        kind = slim.schema["_r"].dataType
        table = slim.select("_r.*").toArrow()  # MOST_BROADCAST rows at most
        near = _with_few(cells, table, kind.simpleString(), lon, lat)
        found = near.withColumn("_b", F.array_min(F.transform("_few", lambda r: _candidate(F.col(lon), F.col(lat), r, carry)))).drop("_few")
    else:
        here = cells.select(F.col(lon).alias("_lon"), F.col(lat).alias("_lat")).filter("_lon is not null and _lat is not null").distinct()
        best = _by_squares(here, slim, carry)
        found = cells.join(best, (F.col(lon) == F.col("_lon")) & (F.col(lat) == F.col("_lat")), "left").drop("_lon", "_lat")
    return found.select(*cells.columns, F.col("_b.k").alias(ref_key), F.col("_b.d").alias("distance_km"), *[F.col(f"_b.c_{c}").alias(c) for c in carry])


def _with_few(cells: DataFrame, refs: pa.Table, kind: str, lon: str, lat: str, slack: float = 1e-9) -> DataFrame:
    """Adds `_few`: the references whose distance is within rounding of the least; none for a cell without a position."""
    entries = pa.StructArray.from_arrays([c.combine_chunks() if c.num_chunks else pa.array([], c.type) for c in refs.columns], names=refs.column_names)
    x, y = (np.radians(refs.column(c).to_numpy().astype(float)) for c in ("lon", "lat"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            cx, cy = (np.radians(batch.column(at[c]).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)) for c in (lon, lat))
            rows, picked = [], []
            for k in range(0, batch.num_rows if len(x) else 0, 1024):
                a, b = cx[k : k + 1024, None], cy[k : k + 1024, None]
                h = np.sin((y - b) / 2) ** 2 + np.cos(b) * np.cos(y) * np.sin((x - a) / 2) ** 2
                i, j = np.nonzero(h <= h.min(axis=1, keepdims=True) * (1 + slack) + 1e-18)  # nothing for a missing position
                rows.append(i + k)
                picked.append(j)
            rows, picked = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (rows, picked))
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), entries.take(pa.array(picked)))], names=[*batch.schema.names, "_few"])

    return cells.mapInArrow(run, cells.select("*", F.lit(None).cast(f"array<{kind}>").alias("_few")).schema)


def _candidate(lon: Column, lat: Column, r: Column, carry: tuple[str, ...]) -> Column:
    return F.struct(haversine_km(lon, lat, r["lon"], r["lat"]).alias("d"), r["k"].alias("k"), *[r[f"c_{c}"].alias(f"c_{c}") for c in carry])


def _by_squares(positions: DataFrame, refs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """(_lon, _lat, _b): each position looks at its square and those around; whoever may have a nearer reference beyond them goes on with larger squares."""
    lon, lat = F.col("_lon"), F.col("_lat")
    open_, done = positions, None
    for side in SQUARES:
        around = max(1, round(360 / side))
        wrap = lambda c: F.pmod(F.floor(c), F.lit(around)).cast("int")  # noqa: E731, B023
        known = refs.withColumn("_y", F.floor(F.col("_r.lat") / side).cast("int")).withColumn("_x", wrap(F.col("_r.lon") / side))
        last = side == SQUARES[-1]
        # so many squares to either side that what lies beyond is a square's side away, which takes more of them towards the poles
        share = F.lit(math.sin(math.radians(min(side, 90.0)))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
        reach = F.when(share >= 1, F.lit(around)).otherwise(F.ceil(F.degrees(F.asin(F.least(share, F.lit(1.0)))) / side))
        xs = F.when(2 * reach + 1 >= around, F.sequence(F.lit(0), F.lit(around - 1))).otherwise(F.transform(F.sequence(-reach, reach), lambda i: F.pmod(F.floor(lon / side) + i, F.lit(around))))  # noqa: B023
        y = F.floor(lat / side).cast("int")
        dealt = open_.withColumn("_y", F.explode(F.sequence(y - 1, y + 1))).withColumn("_x", F.explode(F.transform(xs, lambda x: x.cast("int"))))
        near = dealt.join(known, ["_y", "_x"]).withColumn("_c", _candidate(lon, lat, F.col("_r"), carry))
        best = near.groupBy("_lon", "_lat").agg(F.min("_c").alias("_b"))
        found = open_.join(best, ["_lon", "_lat"], "left")
        sure = F.coalesce(F.col("_b.d") < side * EARTH_KM * math.pi / 180, F.lit(False)) | F.lit(last)
        done = found.filter(sure) if done is None else done.unionByName(found.filter(sure))
        open_ = found.filter(~sure).select("_lon", "_lat")
    return done
