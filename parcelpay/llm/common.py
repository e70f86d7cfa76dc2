"""Shared folder, stored tables and row keys for the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelpay.sources.stage import shared_folder

WHITE = b" \t\n\v\f\r"


class Store:
    """Tables written once to the shared folder and read from there; each operator run has its own folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows per Arrow batch for what is written meanwhile: a batch has a bound in rows only, however wide they are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of the session hold ``size`` bytes at most from now on, unless it already has a smaller bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= size:
        spark.conf.set(key, f"{size}b")


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def splittable(keys: DataFrame, *names: str) -> DataFrame:
    """Rows with distinct keys under fresh names of one struct; a join on them keeps a shuffle of its own, so
    that the adaptive planner can split a hot key of the other side."""
    rest = [c for c in keys.columns if c not in names]
    packed = keys.select(F.struct(*names).alias("k"), *rest)
    packed = packed.groupBy("k").agg(*[F.min(c).alias(c) for c in rest]) if rest else packed.distinct()
    return packed.select(*[F.col(f"k.{n}").alias(n) for n in names], *rest)


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 4 << 20, max_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batch cut so that a slice holds about ``max_bytes`` of one text or list column; a longer value stands alone.

    What a worker turns into Python objects at a time is thus bounded by bytes, not by a number of rows.
    """
    values = batch.column(column)
    ends = values.offsets.to_numpy() if pa.types.is_list(values.type) else np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    width = 1 if not pa.types.is_list(values.type) else 8
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(ends, ends[first] + max_bytes // width, side="right")) - 1
        last = min(max(last, first + 1), first + max_rows, batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def usable(vector: str, kind: str = "array<double>") -> Column:
    """Is the vector there, with finite components only? Empty vectors are."""
    v = F.col(vector).cast(kind)
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def whole_components(vector: str, room: int) -> Column:
    """Components as integers floor(256 * x), taken to the nearest of +-sqrt(room / length) where they lie beyond.

    ``room`` bounds the sum of squares over all components, so that later sums fit the integers they are made in.
    """
    v = F.col(vector).cast("array<double>")
    limit = F.floor(F.sqrt(F.lit(float(room)) / F.greatest(F.size(v), F.lit(1)))).cast("double")
    return F.transform(v, lambda c: F.floor(F.least(F.greatest(c * 256.0, -limit), limit)).cast("long"))
