"""Session settings the library is tuned for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles a method beyond 8000 bytes of bytecode. Clean-up expressions of a text
    # sheet reach that in one fused stage, which then runs interpreted; below the limit Spark
    # splits them into methods that are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> None:
    """Those of the settings that a running session still takes and that change no result."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", SETTINGS["spark.sql.codegen.hugeMethodLimit"])


ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def in_bytes(size: str) -> int:
    """Bytes of a size setting such as ``64m`` or ``67108864b``; a bare number is bytes."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def partitions_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Shuffled partitions of at most this size, unless the session has smaller ones; for steps that sort wide rows."""
    before = spark.conf.get(ADVISORY)
    if in_bytes(before) <= in_bytes(size):
        yield
        return
    spark.conf.set(ADVISORY, size)
    try:
        yield
    finally:
        spark.conf.set(ADVISORY, before)


def configure(builder: SparkSession.Builder, **extra: str) -> SparkSession.Builder:
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder
