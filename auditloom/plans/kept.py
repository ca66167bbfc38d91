"""Tables of a run that a later run with the same input finds again.

A table counts as finished by a row in a small table beside it, appended after it was written
whole; what a lost run left half-written is written anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.columns import col


def table_fingerprint(df: DataFrame) -> str:
    """A digest of columns and rows, whatever the order of rows: two sums of row hashes.

    Each hash covers which columns are null too, as a null leaves a hash as it is. One scan,
    two numbers a task. Maps, which have no hash, are taken as JSON.
    """
    fields = df.schema.fields
    cells = [F.to_json(col(f.name)) if "map<" in f.dataType.simpleString() else col(f.name) for f in fields]
    nulls = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    sums = [F.sum(F.xxhash64(F.lit(seed), nulls, *cells).cast(T.DecimalType(38, 0))) for seed in ("first", "second")]
    counted = df.agg(F.count(F.lit(1)), *sums).first()
    return hashlib.sha256(repr([(f.name, f.dataType.simpleString()) for f in fields] + [str(x) for x in counted]).encode()).hexdigest()


class Kept:
    """Named tables below ``folder``. With ``resume`` finished ones are read, not made again."""

    def __init__(self, df: DataFrame, folder: str, resume: bool):
        self.spark, self.folder, self.resume = df.sparkSession, folder.rstrip("/"), resume
        self.finished: set[str] = set()
        if resume:
            self.mark("started")  # so that there is a table to read
            self.finished = {r["name"] for r in self.spark.read.parquet(f"{self.folder}/finished").distinct().collect()}

    def mark(self, name: str) -> None:
        if name in self.finished:
            return
        if self.resume:
            one = self.spark.range(1).select(F.lit(name).alias("name"))
            one.coalesce(1).write.mode("append").parquet(f"{self.folder}/finished")
        self.finished.add(name)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, made and written if it is not there."""
        path = f"{self.folder}/{name}"
        if name not in self.finished:
            make().write.mode("overwrite").parquet(path)
            self.mark(name)
        return self.spark.read.parquet(path)
