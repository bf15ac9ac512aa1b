"""Results kept under a fingerprint of what they were made from: read when it matches, made again when anything differs."""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import exists


def content_of(df: DataFrame) -> list:
    """Schema, number of rows and two sums of row hashes: the same for any order of the rows. One aggregate."""
    row = [F.col(f"`{c}`") for c in df.columns]
    halves = [F.sum(F.xxhash64(*row, F.lit(s)).cast("decimal(38,0)")) for s in (1, 2)] if row else [F.lit(0), F.lit(0)]
    n, a, b = df.agg(F.count("*"), *halves).first()
    return [df.schema.simpleString(), n, str(a), str(b)]


def fingerprint(inputs: list[DataFrame], settings: dict, code: list[ModuleType | Callable] = ()) -> str:
    """Of the rows of the inputs, the settings, and the text of the code."""
    parts = [[content_of(df) for df in inputs], settings, [inspect.getsource(c) for c in code]]
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def kept(folder: str, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result called `name` under this key: read if it is there, else made, written aside and moved into place whole.

    A writer that is lost leaves nothing under the key; of two that race, the first one's result stays.
    """
    path = f"{folder.rstrip('/')}/{name}-{key}"
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    if not exists(spark, path):
        aside = f"{folder.rstrip('/')}/.{name}-{uuid.uuid4().hex}"
        make().write.parquet(aside)
        jpath = spark._jvm.org.apache.hadoop.fs.Path
        files = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if exists(spark, path) or not files.rename(jpath(aside), jpath(path)):
            files.delete(jpath(aside), True)
    return spark.read.parquet(path)
