"""Writers: tables, metric documents, models, rasters, tile pyramids, Markdown."""

from __future__ import annotations

import json
import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import Forest
from .readers import exists


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_if_absent(df: DataFrame, path: str, force: bool = False) -> bool:
    """Writes a table unless it is there already; whether it wrote."""
    if not force and exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def metric_document(df: DataFrame, most: int = 10_000) -> str:
    """A small table as an indented JSON text (refused beyond `most` rows)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a document")
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=2, default=str)


def markdown(df: DataFrame, digits: int = 3, most: int = 10_000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a document")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def write_forest(spark: SparkSession, model: Forest, path: str) -> None:
    spark.createDataFrame(model.table(), schema="tree int, node int, feature int, threshold double, left int, right int, default_left boolean, value double, cover double").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame([(model.features, model.base)], "features array<string>, base double").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")


def geotiff(values: np.ndarray, west: float, north: float, xres: float, yres: float, nodata: float = -9999.0, epsg: int = 4326) -> bytes:
    """A picture with its place on the globe: one band of floats (height x width), missing values as nodata, or bytes of red, green, blue and alpha (height x width x 4)."""
    colour = values.ndim == 3
    data = np.ascontiguousarray(values, dtype=np.uint8) if colour else np.where(np.isnan(values), nodata, values).astype("<f4")
    h, w = data.shape[:2]
    strips = [zlib.compress(data[y : y + 64].tobytes()) for y in range(0, h, 64)]
    text = f"{nodata:g}\0".encode()
    keys = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, epsg)
    entries: list[tuple[int, int, int, bytes]] = []
    add = lambda tag, kind, fmt, *v: entries.append((tag, kind, len(v), struct.pack("<" + fmt * len(v), *v)))
    add(256, 4, "I", w)
    add(257, 4, "I", h)
    add(258, 3, "H", *([8] * 4 if colour else [32]))
    add(259, 3, "H", 8)
    add(262, 3, "H", 2 if colour else 1)
    add(273, 4, "I", *[0] * len(strips))
    add(277, 3, "H", 4 if colour else 1)
    add(278, 4, "I", 64)
    add(279, 4, "I", *map(len, strips))
    if colour:
        add(338, 3, "H", 2)
    add(339, 3, "H", *([1] * 4 if colour else [3]))
    add(33550, 12, "d", xres, yres, 0.0)
    add(33922, 12, "d", 0.0, 0.0, 0.0, west, north, 0.0)
    add(34735, 3, "H", *keys)
    if not colour:
        entries.append((42113, 2, len(text), text))
    at = 8 + 2 + 12 * len(entries) + 4
    places, extra = {}, b""
    for tag, _, _, raw in entries:
        if len(raw) > 4:
            places[tag] = at + len(extra)
            extra += raw + b"\0" * (len(raw) % 2)
    offsets, pos = [], at + len(extra)
    for s in strips:
        offsets.append(pos)
        pos += len(s)
    raw273 = struct.pack(f"<{len(strips)}I", *offsets)
    if 273 in places:
        i = places[273] - at
        extra = extra[:i] + raw273 + extra[i + len(raw273) :]
    head = struct.pack("<2sHIH", b"II", 42, 8, len(entries))
    for tag, kind, n, raw in entries:
        raw = raw273 if tag == 273 else raw
        head += struct.pack("<HHI", tag, kind, n) + (struct.pack("<I", places[tag]) if tag in places else raw.ljust(4, b"\0"))
    return head + struct.pack("<I", 0) + extra + b"".join(strips)


def geotiff_blocks(cells: DataFrame, value: str | tuple[str, ...], west: float, north: float, xres: float, yres: float, block: int = 512) -> DataFrame:
    """(by, bx, data): the file of each block x block square of a cell table, made where the block lies. value: one column, or those of red, green, blue and alpha."""
    names = [value] if isinstance(value, str) else list(value)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by, bx = int(pdf["by"].iloc[0]), int(pdf["bx"].iloc[0])
        out = np.full((block, block), np.nan) if len(names) == 1 else np.zeros((block, block, len(names)), dtype=np.uint8)
        out[pdf["row"] % block, pdf["col"] % block] = pdf[names[0]].astype(float) if len(names) == 1 else pdf[names].fillna(0)
        return pd.DataFrame([{"by": by, "bx": bx, "data": geotiff(out, west + bx * block * xres, north - by * block * yres, xres, yres)}])

    keyed = cells.select("row", "col", *names, F.floor(F.col("row") / block).cast("int").alias("by"), F.floor(F.col("col") / block).cast("int").alias("bx"))
    return keyed.groupBy("by", "bx").applyInPandas(run, "by int, bx int, data binary")


def encode_png(rgba: np.ndarray) -> bytes:
    h, w, _ = rgba.shape
    body = b"".join(b"\0" + rgba[y].astype(np.uint8).tobytes() for y in range(h))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def tile_blobs(tiles: DataFrame, size: int = 256) -> DataFrame:
    """(zoom, tx, ty, data): a picture for each tile of cut pixels (zoom, tx, ty, ix, iy, r, g, b, a)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((size, size, 4))
        out[pdf["iy"], pdf["ix"]] = pdf[["r", "g", "b", "a"]]
        first = pdf.iloc[0]
        return pd.DataFrame([{"zoom": int(first["zoom"]), "tx": int(first["tx"]), "ty": int(first["ty"]), "data": encode_png(out)}])

    return tiles.select("zoom", "tx", "ty", "ix", "iy", "r", "g", "b", "a").groupBy("zoom", "tx", "ty").applyInPandas(run, "zoom int, tx int, ty int, data binary")


MOST_TILES = 1_000_000


def write_mbtiles(blobs: DataFrame, path: str, name: str) -> int:
    """A tile archive in one SQLite file; tiles pass the driver one partition at a time, MOST_TILES at most: an export for a viewer, not a store."""
    count = blobs.limit(MOST_TILES + 1).count()
    if count > MOST_TILES:
        raise ValueError(f"more than {MOST_TILES} tiles")
    count = 0
    with sqlite3.connect(path) as db:
        db.execute("create table if not exists tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
        db.execute("create table if not exists metadata (name text, value text)")
        for r in blobs.toLocalIterator():
            db.execute("insert into tiles values (?, ?, ?, ?)", (r["zoom"], r["tx"], (1 << r["zoom"]) - 1 - r["ty"], bytes(r["data"])))
            count += 1
        lo, hi = db.execute("select min(zoom_level), max(zoom_level) from tiles").fetchone()
        db.executemany("insert into metadata values (?, ?)", [("name", name), ("format", "png"), ("minzoom", str(lo)), ("maxzoom", str(hi))])
    return count


def tilejson(tiles: DataFrame, name: str, bounds: list[float], url: str) -> str:
    z = tiles.agg(F.min("zoom").alias("lo"), F.max("zoom").alias("hi")).first()
    return json.dumps({"tilejson": "3.0.0", "name": name, "tiles": [url], "minzoom": z["lo"], "maxzoom": z["hi"], "bounds": bounds}, indent=2)


def rows_of(df: DataFrame) -> Iterator[dict]:
    for r in df.toLocalIterator():
        yield r.asDict(recursive=True)
