"""Rasters as cell tables (row, col, value): sampling, rasterising, masks, resampling, pyramids, tiles, seams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, scalar


@dataclass(frozen=True)
class Grid:
    """Where a raster's cells lie: row 0 is the northernmost."""

    west: float
    north: float
    xres: float
    yres: float
    width: int
    height: int

    def holding(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Row and column of the cell that contains a point."""
        return geo.containing(F.lit(self.north) - lat, self.yres), geo.containing(lon - F.lit(self.west), self.xres)

    def nearest(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Row and column of the cell whose centre is nearest."""
        return geo.pixel(F.lit(self.north) - lat, self.yres), geo.pixel(lon - F.lit(self.west), self.xres)

    def inside(self, row: str, col: str) -> Column:
        return F.col(row).between(0, self.height - 1) & F.col(col).between(0, self.width - 1)


def axis_length(low: float, high: float, res: float) -> int:
    """How many centres low + res / 2 + i * res lie before high."""
    n = max(0, round((high - low) / res) + 1)
    while n > 0 and low + res / 2 + (n - 1) * res >= high - 1e-9:
        n -= 1
    return n


def make_grid(spark, lon_min: float, lat_min: float, lon_max: float, lat_max: float, res: float) -> DataFrame:
    """(row, col, longitude, latitude), latitude-major, of every cell whose centre lies before the upper bounds: one range, no join of axes."""
    nx, ny = axis_length(lon_min, lon_max, res), axis_length(lat_min, lat_max, res)
    cells = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"))
    return cells.select("row", "col", geo.axis(F.col("col"), lon_min, res).alias("longitude"), geo.axis(F.col("row"), lat_min, res).alias("latitude"))


def sample(points: DataFrame, cells: DataFrame, grid: Grid, values: list[str], lon: str = "longitude", lat: str = "latitude", default: dict | None = None) -> DataFrame:
    """Points with the values of the cell that holds each, all layers in one join; missing outside, or the layer's default."""
    row, col = grid.holding(F.col(lon), F.col(lat))
    keyed = points.withColumn("_r", row).withColumn("_c", col)
    layers = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *values)
    out = keyed.join(layers, ["_r", "_c"], "left").drop("_r", "_c")
    for name, value in (default or {}).items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def rasterise(points: DataFrame, grid: Grid, value: str, order: list[str], lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """(row, col, value): points dropped on the grid; where several meet, the last by the given order stays."""
    row, col = grid.nearest(F.col(lon), F.col(lat))
    placed = points.withColumn("row", row).withColumn("col", col).filter(grid.inside("row", "col"))
    return placed.groupBy("row", "col").agg(F.max_by(value, F.struct(*order)).alias(value))


def masked(cells: DataFrame, mask: DataFrame, value: str) -> DataFrame:
    """Values where the mask is 1, missing elsewhere."""
    m = mask.select("row", "col", F.col("mask").alias("_m"))
    return cells.join(m, ["row", "col"], "left").withColumn(value, F.when(F.col("_m") == 1, F.col(value))).drop("_m")


def window_of(cells: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """A sub-rectangle, both ends included: a range predicate that reaches the scan."""
    return cells.filter(F.col("row").between(row0, row1) & F.col("col").between(col0, col1))


def block_means(cells: DataFrame, value: Column, height: int, width: int, rows: int, cols: int, least: int = 5, name: str = "mean") -> DataFrame:
    """Mean of each of rows x cols blocks with more than `least` values; what does not fill a block at the far edges is left out."""
    bh, bw = height // rows, width // cols
    br, bc = F.floor(F.col("row") / bh).cast("int"), F.floor(F.col("col") / bw).cast("int")
    out = cells.filter(value.isNotNull()).groupBy(br.alias("br"), bc.alias("bc")).agg(F.avg(value).alias(name), F.count("*").alias("n"))
    return out.filter((F.col("br") < rows) & (F.col("bc") < cols) & (F.col("n") > least))


def downsample(cells: DataFrame, value: str, factor: int) -> DataFrame:
    """Plain mean of the present cells of each factor x factor square (cells count alike; areas are not weighed)."""
    return cells.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg(value).alias(value))


def _shares(index: Column, factor: float, n: int) -> Column:
    """array<struct<at, w>>: the targets, `factor` source cells long, that a source cell meets on one axis, and the length it gives to each: two at most, as targets are no shorter."""
    first = F.floor(index / F.lit(factor))
    edge = (first + 1) * F.lit(factor)
    left = F.least(F.lit(1.0), edge - index)
    both = F.array(F.struct(first.cast("int").alias("at"), left.alias("w")), F.struct((first + 1).cast("int").alias("at"), (F.lit(1.0) - left).alias("w")))
    return F.filter(both, lambda x: (x["w"] > 1e-12) & (x["at"] >= 0) & (x["at"] < n))


def area_average(cells: DataFrame, value: str, height: int, width: int, row_factor: float, col_factor: float) -> DataFrame:
    """Cells of a raster that is row_factor x col_factor times coarser, each the mean of what it covers, weighted by area.

    The new raster has round(size / factor) cells on an axis, one at least. A source cell on the edge of two targets gives each its
    part; missing values take no part and the others' weights make up for them; a target of missing values alone is missing. A row
    is repeated four times at most, and sums combine before the shuffle.
    """
    if min(row_factor, col_factor) < 1:
        raise ValueError("targets must not be smaller than source cells")
    n_rows, n_cols = max(1, round(height / row_factor)), max(1, round(width / col_factor))
    by_row = cells.select(F.explode(_shares(F.col("row"), row_factor, n_rows)).alias("r"), "col", value)
    both = by_row.select("r", F.explode(_shares(F.col("col"), col_factor, n_cols)).alias("c"), value)
    w = F.when(F.col(value).isNotNull(), F.col("r.w") * F.col("c.w"))
    out = both.groupBy(F.col("r.at").alias("row"), F.col("c.at").alias("col")).agg(F.sum(w * F.col(value)).alias("_v"), F.sum(w).alias("_w"))
    return out.select("row", "col", F.when(F.col("_w") > 0, F.col("_v") / F.col("_w")).alias(value))


def zoom_levels(cells: DataFrame, value: str, height: int, width: int, resolution: float, levels: dict[int, float]) -> DataFrame:
    """(zoom, row, col, value): the raster at each zoom's resolution (in the units of its own), by area. Zooms finer than the source are refused."""
    parts = [area_average(cells, value, height, width, target / resolution, target / resolution).select(F.lit(z).alias("zoom"), "row", "col", value) for z, target in sorted(levels.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pyramid(cells: DataFrame, value: str, levels: int) -> DataFrame:
    """(level, row, col, value): level 0 is the input, each further level averages 2 x 2 cells.

    Sums and counts are carried instead of means of means, and every level groups the one below, which is a quarter of it.
    """
    level = cells.select(F.lit(0).alias("level"), "row", "col", F.col(value).alias("_s"), F.col(value).isNotNull().cast("long").alias("_n"))
    out = level
    for k in range(1, levels):
        level = level.groupBy(F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).select(F.lit(k).alias("level"), "row", "col", "_s", "_n")
        out = out.unionByName(level)
    return out.select("level", "row", "col", F.try_divide("_s", F.col("_n")).alias(value))


def bilinear(targets: DataFrame, cells: DataFrame, value: str, y: str = "y", x: str = "x") -> DataFrame:
    """Targets with the value interpolated at the fractional cell position (y, x); missing neighbours drop out and the weights are renormalised."""
    y0, x0 = F.floor(y), F.floor(x)
    fy, fx = F.col(y) - y0, F.col(x) - x0
    corners = F.array(*[F.struct((y0 + dy).cast("int").alias("row"), (x0 + dx).cast("int").alias("col"), ((fy if dy else F.lit(1.0) - fy) * (fx if dx else F.lit(1.0) - fx)).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    keys = targets.columns
    four = targets.withColumn("_k", F.explode(corners)).select(*keys, "_k.row", "_k.col", "_k.w").join(cells.select("row", "col", value), ["row", "col"], "left")
    present = F.when(F.col(value).isNotNull(), F.col("w"))
    out = four.groupBy(*keys).agg(F.sum(F.col("w") * F.col(value)).alias("_v"), F.sum(present).alias("_w"))
    return out.select(*keys, F.when(F.col("_w") > 0, F.col("_v") / F.col("_w")).alias(value))


def to_mercator(cells: DataFrame, grid: Grid, value: str, zoom: int, tile: int = 256) -> DataFrame:
    """(py, px, value): the grid resampled to world pixels of a zoom level that lie within it, by inverse mapping and bilinear weights."""
    import math

    size = tile * 2**zoom
    world = 2 * math.pi * geo.MERCATOR_R
    # cells reach half a cell beyond their centres on every side
    west, north = grid.west - grid.xres / 2, min(85.0, grid.north + grid.yres / 2)
    east, south = grid.west + grid.xres * (grid.width + 0.5), max(-85.0, grid.north - grid.yres * (grid.height + 0.5))
    to_px = lambda lon: (lon + 180) / 360 * size
    to_py = lambda lat: (0.5 - math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) / (2 * math.pi)) * size
    x0, x1, y0, y1 = max(0, math.floor(to_px(west))), min(size, math.ceil(to_px(east))), math.floor(to_py(north)), math.ceil(to_py(south))
    wide = x1 - x0
    px = cells.sparkSession.range(wide * (y1 - y0)).select((F.floor(F.col("id") / wide) + y0).cast("int").alias("py"), (F.col("id") % wide + x0).cast("int").alias("px"))
    lon = (F.col("px") + 0.5) / size * 360 - 180
    my = (F.lit(0.5) - (F.col("py") + 0.5) / size) * world
    lat = F.degrees(2 * F.atan(F.exp(my / geo.MERCATOR_R)) - math.pi / 2)
    where = px.withColumn("y", (F.lit(grid.north) - lat) / grid.yres - 0.5).withColumn("x", (lon - grid.west) / grid.xres - 0.5)
    return bilinear(where, cells, value).select("py", "px", value)


def world_tile(cells: DataFrame, grid: Grid, value: str, size: int = 256) -> DataFrame:
    """The whole world as one tile: cells averaged in the Mercator pixel of their centre."""
    import math

    lon = F.lit(grid.west) + (F.col("col") + 0.5) * grid.xres
    lat = F.lit(grid.north) - (F.col("row") + 0.5) * grid.yres
    px = F.floor((lon + 180) / 360 * size).cast("int")
    py = F.floor((F.lit(0.5) - geo.mercator_y(lat) / (2 * math.pi * geo.MERCATOR_R)) * size).cast("int")
    return cells.groupBy(py.alias("py"), px.alias("px")).agg(F.avg(value).alias(value)).filter(F.col(value).isNotNull())


def colourise(cells: DataFrame, value: str, low: float, high: float, stops=scalar.DIVERGING) -> DataFrame:
    """Cells with r, g, b and alpha: 0 where the value is missing."""
    r, g, b = scalar.ramp(scalar.normalise(F.col(value), low, high), stops)
    zero = F.lit(0)
    return cells.select(*cells.columns, F.coalesce(r, zero).alias("r"), F.coalesce(g, zero).alias("g"), F.coalesce(b, zero).alias("b"), F.when(F.col(value).isNotNull(), 255).otherwise(0).alias("a"))


def cut_tiles(pixels: DataFrame, size: int = 256, row: str = "py", col: str = "px") -> DataFrame:
    """Pixels with their tile (ty, tx) and place in it (iy, ix)."""
    return pixels.withColumns({"ty": F.floor(F.col(row) / size).cast("int"), "tx": F.floor(F.col(col) / size).cast("int"), "iy": F.pmod(row, F.lit(size)), "ix": F.pmod(col, F.lit(size))})


def stitch(tiles: DataFrame, ty: int, tx: int, count: int, size: int = 256) -> DataFrame:
    """A square mosaic of count x count tiles from (ty, tx), with pixel places in the mosaic."""
    some = tiles.filter(F.col("ty").between(ty, ty + count - 1) & F.col("tx").between(tx, tx + count - 1))
    return some.withColumn("my", (F.col("ty") - ty) * size + F.col("iy")).withColumn("mx", (F.col("tx") - tx) * size + F.col("ix"))


def seams(tiles: DataFrame, size: int, channels: tuple[str, ...] = ("r", "g", "b"), least: int = 10) -> DataFrame:
    """(axis, ty, tx, pairs, difference): mean colour difference across the edge to the next tile, where enough visible pairs meet."""
    seen = tiles.filter("a > 0")
    out = None
    for axis, tile, place, along in (("down", "ty", "iy", "ix"), ("right", "tx", "ix", "iy")):
        other = "tx" if tile == "ty" else "ty"
        last = seen.filter(F.col(place) == size - 1).select("ty", "tx", F.col(along).alias("at"), *channels)
        first = seen.filter(F.col(place) == 0).select((F.col(tile) - 1).alias(tile), other, F.col(along).alias("at"), *[F.col(c).alias(f"_{c}") for c in channels])
        diff = sum((F.abs(F.col(c) - F.col(f"_{c}")) for c in channels), F.lit(0)) / len(channels)
        one = last.join(first, ["ty", "tx", "at"]).groupBy("ty", "tx").agg(F.count("*").alias("pairs"), F.avg(diff).alias("difference")).filter(F.col("pairs") >= least).select(F.lit(axis).alias("axis"), "ty", "tx", "pairs", "difference")
        out = one if out is None else out.unionByName(one)
    return out


def inner_differences(tiles: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), least: int = 10) -> DataFrame:
    """(axis, ty, tx, pairs, difference): mean colour difference between neighbouring rows and columns within a tile."""
    seen = tiles.filter("a > 0")
    out = None
    for axis, place, along in (("down", "iy", "ix"), ("right", "ix", "iy")):
        w = Window.partitionBy("ty", "tx", along).orderBy(place)  # one row or column of pixels of a tile
        rows = seen.withColumns({f"_{c}": F.lag(c).over(w) for c in channels}).withColumn("_at", F.lag(place).over(w)).filter(F.col("_at") == F.col(place) - 1)
        diff = sum((F.abs(F.col(c) - F.col(f"_{c}")) for c in channels), F.lit(0)) / len(channels)
        one = rows.groupBy("ty", "tx").agg(F.count("*").alias("pairs"), F.avg(diff).alias("difference")).filter(F.col("pairs") >= least).select(F.lit(axis).alias("axis"), "ty", "tx", "pairs", "difference")
        out = one if out is None else out.unionByName(one)
    return out


def dense_rows(cells: DataFrame, value: str, row: str = "row", col: str = "col") -> DataFrame:
    """(row, values): each row of the raster as an array over all columns, missing cells NULL.

    A row's own cells are gathered into a map; the column axis is one small array.
    """
    axis = cells.select(col).distinct().agg(F.sort_array(F.collect_set(col)).alias("_axis"))  # the raster's width
    rows = cells.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(col, value))).alias("_m"))
    return rows.crossJoin(F.broadcast(axis)).select(row, F.transform("_axis", lambda c: F.try_element_at(F.col("_m"), c)).alias("values"))


def replace_level(tiles: DataFrame, level: int, fresh: DataFrame, zoom: str = "zoom") -> DataFrame:
    return tiles.filter(F.col(zoom) != level).unionByName(fresh)
