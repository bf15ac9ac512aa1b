"""Readers: tables, flux exports, key/value files, layer registries, models, polygons, rasters, pictures, tile archives, traces."""

from __future__ import annotations

import json
import re
import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import nan_to_null, tokens_to_null
from ..operators.ingest import description_fields
from ..operators.models import Forest

# Layers of the covariate registry and their files; soil layers are kept per region.
SOIL_LAYERS = ("soc", "nitrogen", "phh2o", "clay", "sand", "silt", "bdod", "cec")
GLOBAL_LAYERS = {
    **{f"bio{k:02d}": f"worldclim/wc2.1_30s_bio_{k}.tif" for k in (1, 4, 5, 6, 12, 14, 15, 17)},
    "npp": "modis/npp_2020_2024_mean.tif", "lst_day": "modis/lst_day_2020_2024_mean.tif", "lst_night": "modis/lst_night_2020_2024_mean.tif", "landcover": "modis/landcover_igbp_2023.tif",
}
SITE_FILES = ("cosore_annual.csv", "annual_summaries.csv", "description.csv", "sites.csv")
FLUX_SCHEMA = "CSR_PORT int, CSR_TIMESTAMP_BEGIN double, CSR_FLUX_CO2 double"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def required(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table with a header: given types, or those found in the whole file; missing-value texts and NaN become NULL."""
    reader = spark.read.option("header", True)
    if schema:
        return nan_to_null(tokens_to_null(reader.schema(schema).csv(required(spark, path))))
    text = tokens_to_null(reader.csv(required(spark, path)))
    number = [c for c in text.columns if c]
    counts = text.agg(*[(F.count(c) == F.count(F.col(c).try_cast("double"))).alias(c) for c in number]).first()
    return nan_to_null(text.select(*[F.col(c).cast("double").alias(c) if counts[c] else F.col(c) for c in number]))


def read_first(spark: SparkSession, folder: str, names: tuple[str, ...] = SITE_FILES) -> DataFrame | None:
    """The first of several files that the folder holds, or None."""
    for n in names:
        if exists(spark, f"{folder}/{n}"):
            return read_csv(spark, f"{folder}/{n}")
    return None


def read_flux(spark: SparkSession, pattern: str) -> DataFrame:
    """Flux exports (CSV, one folder for each dataset) as (dataset, port, t, flux); folders named TEST* are skipped.

    R's own serialised files have no reader here: datasets must be exported. Rows that cannot be read are dropped.
    """
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").schema(FLUX_SCHEMA).csv(pattern)
    dataset = F.element_at(F.split(F.input_file_name(), "/"), -2)
    rows = raw.select(dataset.alias("dataset"), F.col("CSR_PORT").alias("port"), F.timestamp_seconds("CSR_TIMESTAMP_BEGIN").alias("t"), F.col("CSR_FLUX_CO2").alias("flux"))
    return nan_to_null(rows.filter(~F.startswith("dataset", F.lit("TEST"))))


def read_descriptions(spark: SparkSession, pattern: str) -> DataFrame:
    """(dataset, field, value) of `name: value` files, one folder for each dataset."""
    lines = spark.read.text(pattern).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("dataset"), F.col("value").alias("line")).withColumn("line_no", F.monotonically_increasing_id())
    return description_fields(lines.filter(~F.startswith("dataset", F.lit("TEST"))), "dataset")


def registry(spark: SparkSession, root: str, region: str, depth: str = "5-15cm") -> DataFrame:
    """(feature, region, path): where each layer of a region lies."""
    rows = [(v, region, f"{root}/soilgrids/{v}_{depth}_{region}_5km.tif") for v in SOIL_LAYERS] + [(k, region, f"{root}/{p}") for k, p in GLOBAL_LAYERS.items()]
    return spark.createDataFrame(rows, "feature string, region string, path string")


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length) of files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path", "length")


def present_layers(layers: DataFrame, files: DataFrame, least_bytes: int = 1024) -> DataFrame:
    """Registry rows whose file exists and is larger than a stub."""
    found = files.filter(F.col("length") > least_bytes).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    return layers.join(found, "path", "left_semi")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(required(spark, path), multiLine=True)


def read_forest(spark: SparkSession, path: str, features: list[str]) -> Forest:
    """A saved model; raises if its feature order is not the one expected."""
    head = spark.read.parquet(f"{required(spark, path)}/head").first()
    if list(head["features"]) != list(features):
        raise ValueError(f"feature order differs: {head['features']}")
    return Forest.of(spark.read.parquet(f"{path}/trees").orderBy("tree", "node").toPandas(), features, head["base"])


def read_config(path: str) -> dict:
    """A nested configuration from JSON, or from YAML where a reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text)


def rings_of_wkt(text: str) -> list[list[tuple[float, float]]]:
    """All rings of a POLYGON or MULTIPOLYGON text."""
    return [[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", text)]


def rings_of_geojson(text: str) -> list[list[tuple[float, float]]]:
    g = json.loads(text)
    g = g.get("geometry", g)
    polygons = g["coordinates"] if g["type"] == "MultiPolygon" else [g["coordinates"]]
    return [[(float(x), float(y)) for x, y, *_ in ring] for polygon in polygons for ring in polygon]


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height x width x channels) of a plain 8-bit picture."""
    at, body, width, height, kind = 8, b"", 0, 0, 0
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        if name == b"IHDR":
            width, height, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
            if depth != 8 or lace or kind not in (0, 2, 4, 6):
                raise ValueError("only plain 8-bit pictures")
        elif name == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    n = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, (width + 1) * n), dtype=np.int64)
    for y in range(height):
        f, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        up, now = out[y], out[y + 1]
        if f in (0, 2):
            now[n:] = (line + (up[n:] if f else 0)) & 255
            continue
        if f == 1:
            now[n:] = (line.reshape(width, n).cumsum(axis=0) & 255).ravel()
            continue
        for i in range(width * n):
            a, b, c = now[i], up[i + n], up[i]
            if f == 3:
                p = (a + b) // 2
            else:
                e = a + b - c
                p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))[2]
            now[i + n] = (line[i] + p) & 255
    return out[1:, n:].reshape(height, width, n).astype(np.uint8)


def read_pictures(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, py, px, r, g, b, a) of pictures, one row for each pixel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                x = decode_png(bytes(content))
                h, w, n = x.shape
                rgb = x[:, :, :3] if n >= 3 else np.repeat(x[:, :, :1], 3, axis=2)
                a = x[:, :, n - 1] if n in (2, 4) else np.full((h, w), 255)
                py, px = np.indices((h, w))
                yield pd.DataFrame({"path": path, "py": py.ravel(), "px": px.ravel(), "r": rgb[:, :, 0].ravel(), "g": rgb[:, :, 1].ravel(), "b": rgb[:, :, 2].ravel(), "a": a.ravel()})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "path string, py int, px int, r int, g int, b int, a int")


#: Bytes and notation of the kinds of numbers in a raster's directory.
TIFF_KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}


def tiff_tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first directory of a TIFF, plain or of the large form."""
    order = "<" if data[:2] == b"II" else ">"
    large = struct.unpack(order + "H", data[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if large else "I"), data[8:16] if large else data[4:8])[0]
    count, at = (struct.unpack(order + "Q", data[at : at + 8])[0], at + 8) if large else (struct.unpack(order + "H", data[at : at + 2])[0], at + 2)
    step, room = (20, 8) if large else (12, 4)
    tags = {}
    for k in range(count):
        e = data[at + k * step : at + (k + 1) * step]
        tag, kind = struct.unpack(order + "HH", e[:4])
        n = struct.unpack(order + ("Q" if large else "I"), e[4 : 4 + room])[0]
        if kind not in TIFF_KINDS:
            continue
        size, sign = TIFF_KINDS[kind]
        raw = e[4 + room :]
        if size * n > room:
            start = struct.unpack(order + ("Q" if large else "I"), raw[:room])[0]
            raw = data[start : start + size * n]
        tags[tag] = (raw[:n].rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{n}{sign}", raw[: size * n])
    return order, tags


def lzw_decode(data: bytes) -> bytes:
    """The LZW form of TIFF: codes of 9 to 12 bits, the widest bit first."""
    out, bits, held, width = bytearray(), 0, 0, 9
    table: list[bytes] = []
    last = b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def tiff_blocks(data: bytes, band: int = 1, window: tuple[int, int, int, int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, values) of each strip or tile that meets the window (row, column, rows, columns); only these are decoded."""
    order, t = tiff_tags(data)
    one = lambda tag, default: t.get(tag, (default,))[0]
    w, h, n = one(256, 0), one(257, 0), one(277, 1)
    bits, kind, packing, predictor, apart = one(258, 1), one(339, 1), one(259, 1), one(317, 1), one(284, 1) == 2
    if packing not in (1, 5, 8, 32946) or bits not in (8, 16, 32, 64):
        raise ValueError(f"a raster packed in a way that is not read: {packing}, {bits} bits")
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8))
    bw, bh = (one(322, w), one(323, h)) if 324 in t else (w, min(one(278, h), h))
    offsets, counts = (t[324], t[325]) if 324 in t else (t[273], t[279])
    across, down = -(-w // bw), -(-h // bh)
    r0, c0, rows, cols = window or (0, 0, h, w)
    each = 1 if apart else n
    for by in range(down):
        for bx in range(across):
            if by * bh >= r0 + rows or (by + 1) * bh <= r0 or bx * bw >= c0 + cols or (bx + 1) * bw <= c0:
                continue
            k = by * across + bx + ((band - 1) * across * down if apart else 0)
            raw = data[offsets[k] : offsets[k] + counts[k]]
            raw = raw if packing == 1 else lzw_decode(raw) if packing == 5 else zlib.decompress(raw)
            high = bh if 324 in t else min(bh, h - by * bh)
            if predictor == 3:  # bytes of equal weight lie together, as differences
                parts = np.frombuffer(raw, np.uint8)[: high * bw * each * bits // 8].reshape(high, -1)
                lanes = np.cumsum(parts.reshape(high, -1, each), axis=1, dtype=np.uint8).reshape(high, bits // 8, bw * each)
                x = np.ascontiguousarray(lanes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(high, bw, each)
            else:
                x = np.frombuffer(raw, dtype)[: high * bw * each].reshape(high, bw, each)
                if predictor == 2:
                    x = np.cumsum(x, axis=1, dtype=dtype.newbyteorder("="))
            x = x[: min(high, h - by * bh), : min(bw, w - bx * bw), 0 if apart else band - 1]
            top, left = max(0, r0 - by * bh), max(0, c0 - bx * bw)
            yield by * bh + top, bx * bw + left, x[top : r0 + rows - by * bh, left : c0 + cols - bx * bw].astype(float)


def read_geotiff(spark: SparkSession, pattern: str, band: int = 1, nodata_mask: bool = True, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, row, col, longitude, latitude, value) of rasters, one row for each cell, in the coordinates of the file; nodata and NaN become NULL.

    window: (row, column, rows, columns) to read, block by block.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content)
                _, t = tiff_tags(data)
                xres, yres = t.get(33550, (1.0, 1.0))[:2]
                i, j, _, x0, y0 = t.get(33922, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))[:5]
                empty = float(t[42113][0].strip() or "nan") if 42113 in t else np.nan
                for r, c, x in tiff_blocks(data, band, window):
                    row, col = np.indices(x.shape)
                    row, col = row.ravel() + r, col.ravel() + c
                    v = x.ravel()
                    known = ~np.isnan(v) & ~((v == empty) | (v == np.float32(empty)) if nodata_mask else np.zeros(len(v), bool))
                    yield pd.DataFrame({"path": path, "row": row, "col": col, "longitude": x0 + (col + 0.5 - i) * xres, "latitude": y0 - (row + 0.5 - j) * yres, "value": pd.Series(v).astype(object).where(known, None)})

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(run, "path string, row int, col int, longitude double, latitude double, value double")


def read_mbtiles(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, zoom, tx, ty, data) of tile archives, rows counted from the north."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with sqlite3.connect(":memory:") as db:
                    db.deserialize(bytes(content))
                    found = db.execute("select zoom_level, tile_column, tile_row, tile_data from tiles order by 1, 2, 3")
                    while some := found.fetchmany(256):
                        yield pd.DataFrame([(path, z, x, (1 << z) - 1 - y, bytes(d)) for z, x, y, d in some], columns=["path", "zoom", "tx", "ty", "data"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "path string, zoom int, tx int, ty int, data binary")


def read_traces(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, line_no, x, y) of electrochemistry traces: pairs of numbers after any preamble; a cut-off last line is dropped."""
    number = r"([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)"
    pair = rf"^\s*{number}\s*,\s*{number}\s*$"
    lines = spark.read.text(pattern).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line_no"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("v"))
    rows = lines.filter(F.rlike("v", F.lit(pair)))
    return rows.select("path", "line_no", F.regexp_extract("v", pair, 1).try_cast("double").alias("x"), F.regexp_extract("v", pair, 2).try_cast("double").alias("y")).filter("x is not null and y is not null")
