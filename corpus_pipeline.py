"""From raw documents to packed training sequences, one stored stage after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelpay.llm import exact_dedup, language, near_dedup, quality
from parcelpay.llm.common import Store, bound_batches
from parcelpay.llm.queries import pack_tokens, ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _ready(spark: SparkSession) -> None:
    """Executors have the package, and Arrow batches, which hold all columns of a document here, are bounded by bytes."""
    ship(spark)
    bound_batches(spark)


def _with_private_names(docs: DataFrame, score: Callable[[DataFrame, list[str], str], DataFrame]) -> DataFrame:
    """All columns under names that clash with nothing, and the columns that ``score`` adds."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return score(docs.toDF(*names), names, names[docs.columns.index("text")])


def _restored(scored: DataFrame, docs: DataFrame) -> DataFrame:
    return scored.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and texts without a letter go."""
    _ready(spark)
    model = language.train_language(docs)
    scored = _with_private_names(docs, lambda d, keys, text: language.identify(d, model, keys=keys, text_col=text))
    return _restored(scored.where(F.col("lang_pred") != "und"), docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking model, trained on the labels of the folder, puts above its threshold.

    Labels of one kind only rank nothing, so all documents stay then.
    """
    _ready(spark)
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.trained:
        return docs
    scored = _with_private_names(docs, lambda d, keys, text: quality.score_quality(d, model, keys=keys, text_col=text))
    return _restored(scored.where("predicted = 1"), docs)


def _private(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """All columns under private names, and those of id and text."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; null text counts as empty, and null ids come last."""
    _ready(spark)
    kept = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    rows, doc, text = _private(docs)
    own = F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", ""), 256)
    rows = rows.withColumn("_own", own)
    same = rows.join(kept, F.col(doc).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left_semi")
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # Rows repeating both id and text: the longest one stays.
        order = Window.partitionBy(doc, "_own").orderBy(F.length(text).desc_nulls_last(), text)
        same = same.withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    return _restored(same, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8).

    Of rows that repeat an id only those go whose own text is in a component with a smaller id. Rows without an id or
    without words stay.
    """
    _ready(spark)
    gone = near_dedup.near_dedup(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows, doc, text = _private(docs)
    same = (F.col(doc) == F.col("_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_key"))
    return _restored(rows.join(gone, same, "left_anti"), docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document piece, in token ids, in the packed sequences."""
    _ready(spark)
    return pack_tokens(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("best_fit_packing", best_fit),
]

#: No stage but the exact deduplication has a plain SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return docs
