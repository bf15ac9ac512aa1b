"""Serialised R tables written byte by byte, and results kept under a fingerprint."""

import bz2
import gzip
import lzma
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.plans import models as plans
from terralith.sources import kept, rds

DATA = "/root/testdata/sf0.001"


def word(*v):
    return struct.pack(f">{len(v)}i", *v)


NULL = word(254)


def chars(s):
    return word(9 | 0x8000 << 0, -1) if s is None else word(0x40009, len(s.encode())) + s.encode()


def strings(values, more=b""):
    return word(16 | (0x200 if more else 0), len(values)) + b"".join(map(chars, values)) + more


def symbol(s):
    return word(1) + chars(s)


def pairs(**kv):
    return b"".join(word(0x402) + (v[0] if isinstance(v, tuple) else symbol(k)) + (v[1] if isinstance(v, tuple) else v) for k, v in kv.items()) + NULL


def integers(values, more=b""):
    return word(13 | (0x200 if more else 0) | (0x100 if more else 0), len(values), *[-(2**31) if v is None else v for v in values]) + more


def reals(values):
    return word(14, len(values)) + struct.pack(f">{len(values)}d", *values)


def sequence(n, start, step):
    info = word(2) + symbol("compact_intseq") + word(2) + symbol("base") + word(2) + integers([13]) + NULL
    return word(238) + info + reals([n, start, step]) + NULL


def frame(columns, n, classes=("data.frame",)):
    head = b"X\n" + word(3, 0x40300, 0x30500, 5) + b"UTF-8"
    return head + word(19 | 0x300, len(columns)) + b"".join(columns.values()) + pairs(names=strings(list(columns)), **{"row.names": integers([None, -n])}, **{"class": strings(list(classes))})


def flux(n=4, **other):
    columns = {"CSR_PORT": integers([1, 2, None, 1][:n]), "CSR_TIMESTAMP_BEGIN": reals([86400.0 * k for k in range(n)]), "CSR_FLUX_CO2": reals([0.5, float("nan"), 2.0, 3.0][:n]), **other}
    return frame(columns, n)


def test_values():
    factor = integers([2, None, 1, 2], pairs(levels=strings(["a", "é"]), **{"class": strings(["factor"])}))
    got = rds.data_frame(flux(4, kind=factor, text=strings(["x", None, "", "y"]), seq=sequence(4, 10, 2), yes=word(10, 4, 1, 0, -(2**31), 1)))
    assert got["kind"] == ["é", None, "a", "é"] and got["text"] == ["x", None, "", "y"] and got["seq"].tolist() == [10, 12, 14, 16]
    assert np.array_equal(got["CSR_PORT"], [1, 2, np.nan, 1], equal_nan=True) and np.array_equal(got["yes"], [1, 0, np.nan, 1], equal_nan=True)
    # a symbol met again is a reference to the first
    twice = b"X\n" + word(2, 0, 0) + word(19 | 0x200, 1) + integers([3], pairs(names=strings(["z"]))) + pairs(names=(word(255 | 1 << 8), strings(["v"])), **{"class": strings(["tbl", "data.frame"])})
    assert rds.data_frame(twice)["v"].tolist() == [3]


def test_files(spark, tmp_path):
    whole = flux()
    for name, raw in {"a": gzip.compress(whole), "b": bz2.compress(whole), "c": lzma.compress(whole), "d": whole, "cut": whole[:90], "none": b"", "text": b"A\n2", "list": frame({"x": integers([1])}, 1, ("other",)), "lacks": frame({"CSR_PORT": integers([1])}, 1), "empty": flux(0), "bent": gzip.compress(whole)[:-20]}.items():
        (tmp_path / f"{name}.RDS").write_bytes(raw)
    (tmp_path / "note.txt").write_text("no table")
    good, skipped = rds.read_flux(spark, str(tmp_path))
    rows = good.collect()
    assert sorted(os.path.basename(r.path) for r in rows) == [f"{x}.RDS" for x in "aabbccdd"]
    assert {(r.port, r.flux) for r in rows} == {(1, 0.5), (1, 3.0)} and sum(r.n for r in skipped.collect()) == 5  # the file of no bytes is not seen
    with pytest.raises(ValueError, match="type"):
        rds.read_rds(spark, str(tmp_path), {"x": "int"})


def test_kept_results(spark, tmp_path):
    df, made = spark.range(10).withColumn("x", F.col("id") * 2), []

    def result(rows, settings, code=()):
        key = kept.fingerprint([rows], settings, list(code))
        return kept.kept(str(tmp_path), "r", key, lambda: made.append(key) or rows.filter("id > 2")).count()

    assert [result(df, {"a": 1}), result(df.orderBy(F.desc("id")).repartition(3), {"a": 1})] == [7, 7] and len(made) == 1
    assert result(df, {"a": 2}) == 7 and len(made) == 2  # another setting
    assert result(df.limit(9), {"a": 1}) == 6 and len(made) == 3  # other rows
    assert result(df, {"a": 1}, [test_files]) == 7 and len(made) == 4  # other code
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".r-")]  # nothing half done stays


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_a_grid_is_scored_once(spark, tmp_path):
    few = ["bio01", "bio12", "bio14"]
    a = plans.modis_grid(spark, DATA, str(tmp_path), few)
    files = set(os.listdir(tmp_path))
    assert a.count() == plans.grid(spark).count() and a.filter("log_rs_pred is null").count() == 0
    assert plans.modis_grid(spark, DATA, str(tmp_path), few).collect() == a.collect() and set(os.listdir(tmp_path)) == files
    plans.modis_grid(spark, DATA, str(tmp_path), ["bio01", "bio12"])
    assert len(os.listdir(tmp_path)) == len(files) + 1
