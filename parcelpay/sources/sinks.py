"""Report writers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_report(df: DataFrame, path: str, file_format: str = "parquet", partition_by: tuple[str, ...] = (), keep_others: bool = False) -> None:
    """Overwrite a report folder, split into partition folders by the given columns.

    With ``keep_others`` only the partition folders that have rows in ``df`` are replaced.
    """
    writer = df.write.mode("overwrite").format(file_format).option("partitionOverwriteMode", "dynamic" if keep_others else "static")
    if file_format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_period_report(df: DataFrame, path: str, period: str, file_format: str = "parquet") -> None:
    """Report of one period under ``period=...``; other periods in the folder stay. An empty report clears its period.

    Readers must not be at work meanwhile; ``PeriodReports`` is for reports that are read while they are rewritten.
    """
    write_report(df, f"{path}/period={period}", file_format)


class PeriodReports:
    """Reports by period that are read while others are written.

    Each write goes to a version folder of its own, and a small manifest file per period names the version in force.
    The manifest is replaced by one rename after all files are there, so a reader sees the old report or the new one,
    and a write that fails changes nothing. A period rewritten without rows has a version without rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _files(self, folder: str) -> list[str]:
        path = self._hadoop.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(self._conf)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def write(self, df: DataFrame, period: str) -> None:
        version = f"{period}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/versions/{version}")
        self._switch(period, json.dumps({"version": version, "schema": df.schema.json()}))

    def _switch(self, period: str, text: str) -> None:
        fresh, path = (self._hadoop.Path(f"{self.path}/{folder}/{period}") for folder in (f"fresh/{uuid.uuid4().hex}", "manifest"))
        fs = path.getFileSystem(self._conf)
        fs.mkdirs(path.getParent())
        out = fs.create(fresh)
        out.write(bytearray(text.encode()))
        out.close()
        overwrite = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        overwrite[0] = self._hadoop.Options.Rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(path.toUri(), self._conf).rename(fresh, path, overwrite)
        fs.delete(fresh.getParent(), True)

    def manifest(self) -> dict[str, dict[str, str]]:
        """Version and schema in force by period. One small file per period is read."""
        names = self._files("manifest")
        if not names:
            return {}
        texts = self.spark.read.text(f"{self.path}/manifest", wholetext=True).select("_metadata.file_name", "value").collect()
        return {r.file_name: json.loads(r.value) for r in texts}

    def read(self, *periods: str) -> DataFrame:
        """The reports in force of the given periods, or of all, with a ``period`` column."""
        held = self.manifest()
        chosen = [p for p in (periods or sorted(held)) if p in held]
        if not chosen:
            raise ValueError(f"no report under {self.path} for {', '.join(periods) or 'any period'}")
        parts = []
        for p in chosen:
            schema = T.StructType.fromJson(json.loads(held[p]["schema"]))
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/versions/{held[p]['version']}")
            parts.append(rows.withColumn("period", F.lit(p)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def vacuum(self) -> int:
        """Delete versions that no manifest names, those of failed and of replaced writes; only when no one reads them."""
        held, gone = {m["version"] for m in self.manifest().values()}, 0
        for period in self._files("versions"):
            for name in self._files(f"versions/{period}"):
                if f"{period}/{name}" not in held:
                    path = self._hadoop.Path(f"{self.path}/versions/{period}/{name}")
                    gone += path.getFileSystem(self._conf).delete(path, True)
        return gone


def write_canonical(df: DataFrame, path: str) -> None:
    """Canonical sheet at rest, by month, so that a period reads only its months; undated sheets as they are.

    Rows are rebalanced on the month: the planner splits a large month over several tasks by size and joins small
    ones, so no month is bound to one task or to a fixed number of files.
    """
    if "event_ts" not in df.columns:
        write_report(df, path)
        return
    dated = df.withColumn("period_month", F.date_format("event_ts", "yyyy-MM"))
    write_report(dated.hint("rebalance", F.col("period_month")), path, "parquet", ("period_month",))


def write_then_read(df: DataFrame, path: str) -> DataFrame:
    """Write a result once in shared storage and continue from the files.

    For a plan that feeds several reports: it is computed once and survives lost executors.
    """
    write_report(df, path)
    return df.sparkSession.read.parquet(path)
