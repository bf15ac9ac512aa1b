"""The streamed flux equals the batch flux: by window, but for windows that are still open, and by port for any cut into batches."""

import random

from pyspark.sql import functions as F

from terralith.operators.ingest import integrate_flux
from terralith.streaming.flux import daily_flux, day_totals, integrate_totals, merged, write_daily, write_totals


def test_stream_equals_batch(spark, tmp_path):
    rows = [(p, f"2024-01-{d:02d} {h:02d}:00:00", float(p * d + h)) for p in (1, 2) for d in range(1, 9) for h in (1, 13)]
    df = spark.createDataFrame(rows, "port int, t string, flux double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = write_daily(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r["start"], r["port"]): (r["n"], r["mean_flux"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["port"]): (r["n"], r["mean_flux"]) for r in daily_flux(df).select(F.col("window.start").alias("start"), "port", "n", "mean_flux").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 4


PORT_SCHEMA = "port int, t timestamp_ntz, flux double, batch string, n string, day string"


def port_rows(seed: int) -> list[tuple]:
    from datetime import datetime, timedelta

    rng = random.Random(seed)
    rows = [(p, datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 24 * 40 // p)), rng.choice([rng.uniform(-9, 80), 3.5, None]), "x", "clash", "") for p in range(1, 6) for _ in range(150)]
    return [*rows, *rows[:20], (None, datetime(2024, 1, 1), 1.0, "x", "", ""), (1, None, 1.0, None, None, None)]


def close(got, want):
    got, want = ({r["port"]: r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(want)
    for k, w in want.items():
        g = got[k]
        assert (g["n"], g["n_days"], g["span_days"]) == (w["n"], w["n_days"], w["span_days"])
        assert abs(g["mean_flux"] - w["mean_flux"]) < 1e-9 and abs(g["rs_annual"] - w["rs_annual"]) < 1e-6


def test_ports_of_a_stream_equal_the_batch_for_any_cut(spark, tmp_path):
    limits = {"least_days": 10, "least_span": 12}
    rows = port_rows(3)
    random.Random(1).shuffle(rows)  # days come in any order, late ones too
    whole = spark.createDataFrame(rows, PORT_SCHEMA)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, part in (("a", rows[:1]), ("b", rows[1:400]), ("c", rows[400:])):  # the second start takes up where the first ended
        spark.createDataFrame(part, PORT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if name != "b":
            write_totals(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    left = spark.read.parquet(f"{tmp_path}/out")
    assert left.select("batch").distinct().count() == 3
    close(integrate_totals(left, **limits), integrate_flux(whole, **limits))
    close(integrate_totals(merged(left), **limits), integrate_flux(whole, **limits))


def test_totals_of_no_rows(spark):
    empty = spark.createDataFrame([], PORT_SCHEMA)
    assert day_totals(empty).count() == 0 and integrate_totals(day_totals(empty)).count() == 0
