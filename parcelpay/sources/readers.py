"""Sheet and table scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelpay.sources.headers import DATABASE_HEADERS, clean_headers, rename_first_wins
from parcelpay.sources.stage import Stage


def read_csv_sheet(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """CSV sheet with cleaned headers and every cell as text.

    No type inference: it would cost a pass over the data and break waybills. ``multi_line`` is
    only for files with line breaks inside quotes, since it makes a file unsplittable.
    """
    raw = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    return raw.toDF(*clean_headers(raw.columns))


REJECTED = "__rejected"


def read_csv_with_rejects(
    spark: SparkSession, path: str | list[str], stage: Stage | None = None, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The clean sheet, and (file, line) of every record that does not fit its header: short, long or broken ones.

    The files are read once: all records are stored, and both results are parts of the stored table. A reader without
    rejects would fill short records with nulls and drop the end of long ones.
    """
    stage = stage or Stage(spark)
    options = {"header": True, "inferSchema": False, "encoding": "UTF-8", "escape": '"', "multiLine": multi_line}
    headers = spark.read.options(**options).csv(path).columns
    fields = T.StructType([T.StructField(c, T.StringType()) for c in [*headers, REJECTED]])
    raw = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED).schema(fields).csv(path)
    names = clean_headers(headers)
    if len(set(names)) < len(names) or REJECTED in names:
        raise ValueError(f"headers are not distinct: {', '.join(names)}")
    numbered = raw.select("*", F.col("_metadata.file_path").alias("__file")).toDF(*[f"c{i}" for i in range(len(names))], "line", "file")
    kept = stage.put(numbered, "records")
    clean = kept.where("line IS NULL").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
    return clean, kept.where("line IS NOT NULL").select("file", "line")


@dataclass(frozen=True)
class JdbcSplit:
    """Numeric, date or timestamp column whose range is cut into parallel reads."""

    column: str
    lower: str
    upper: str
    partitions: int


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    split: JdbcSplit | None = None,
    fetch_size: int = 10_000,
    properties: dict[str, str] | None = None,
) -> dict[str, str]:
    """Options of a JDBC scan of a table or a query; exactly one of the two.

    A split query is passed as a derived table, because Spark splits only ``dbtable`` scans.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    if split is None:
        options["dbtable" if table else "query"] = table or str(query)
        return options
    options["dbtable"] = table or f"({query}) AS source_rows"
    options["partitionColumn"] = split.column
    options["lowerBound"] = split.lower
    options["upperBound"] = split.upper
    options["numPartitions"] = str(split.partitions)
    return options


def read_jdbc_sheet(spark: SparkSession, sheet: str, **options: object) -> DataFrame:
    """Database table or query under sheet headers; filters and columns are pushed to the database."""
    raw = spark.read.format("jdbc").options(**jdbc_options(**options)).load()
    return rename_first_wins(raw, DATABASE_HEADERS.get(sheet, {}))
