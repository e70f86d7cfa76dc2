"""One named query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelpay.llm import (
    byte_bpe, chat, exact_dedup, hard_negatives, language, licenses, near_dedup, neighbours, packing, pii, quality, token_files, vector_codes,
)
from parcelpay.llm.common import Store

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give executors this package, unless their PYTHONPATH already has it."""
    sc = spark.sparkContext
    if ROOT in os.environ.get("PYTHONPATH", "").split(":") or any(f.startswith("parcelpay") for f in sc._python_includes):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "parcelpay.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(ROOT, "parcelpay")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(path)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return fn(spark, d)

    QUERIES[fn.__name__] = run
    return fn


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def pack_tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pieces and bins in ids of the tokenizer of ``op2_token_files``, end ids included."""
    lengths = Store(spark).put(token_files.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")), "lengths")
    return packing.best_fit_packing(lengths, length_col="n_tokens")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


@query
def op1_exact_dedup(spark, d):
    return exact_dedup.exact_dedup(_documents(spark, d))


ORACLE["op1_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


@query
def op2_token_files(spark, d):
    path = Store(spark).path("tokens")
    token_files.write_token_files(_documents(spark, d), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.file_digest(spark, path)


@query
def op3_chat(spark, d):
    return chat.format_chats(spark.read.parquet(f"{d}/conversations.parquet"))


_SAFE = r"regexp_replace({}, '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g')"
ORACLE["op3_chat"] = rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list({{'r': role, 't': text}} ORDER BY position) AS turns FROM p GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, n_turns, turns, count(*) AS copies FROM c GROUP BY n_turns, turns),
m AS (SELECT conv_id, n_turns, copies FROM k WHERE NOT EXISTS (
        SELECT 1 FROM c b WHERE b.turns[1] = k.turns[1] AND b.n_turns > k.n_turns AND b.turns[1:k.n_turns] = k.turns))
SELECT m.conv_id, CAST((position - 1) // 512 AS BIGINT) AS part, m.n_turns, m.copies,
       string_agg('<|im_start|>' || {_SAFE.format("role")} || chr(10) || {_SAFE.format("text")} || '<|im_end|>' || chr(10), '' ORDER BY position) AS text
FROM m JOIN p ON p.conv_id = m.conv_id GROUP BY m.conv_id, (position - 1) // 512, m.n_turns, m.copies
"""


@query
def op4_licenses(spark, d):
    docs = _documents(spark, d)
    return licenses.scan_licenses(docs, licenses.train_licenses(docs))


@query
def op5_near_dedup(spark, d):
    return near_dedup.near_dedup(_documents(spark, d), size=3, percent=85)


@query
def op6_language(spark, d):
    docs = _documents(spark, d).withColumn("held_out", held_out())
    model = language.train_language(docs.where("not held_out"))
    return language.identify(docs, model, keys=["doc_id", "held_out"])


@query
def op7_byte_bpe(spark, d):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(_documents(spark, d), path, pattern)


@query
def op8_packing(spark, d):
    return pack_tokens(spark, _documents(spark, d))


@query
def op9_neighbours(spark, d):
    return neighbours.nearest(spark.read.parquet(f"{d}/embeddings.parquet"), lambda c: F.col(c) % 20 == 0)


@query
def op10_quality(spark, d):
    docs = _documents(spark, d).withColumn("held_out", held_out())
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train_quality(docs.where("not held_out"), labels)
    return quality.score_quality(docs, model, keys=["doc_id", "held_out"])


@query
def op11_pii(spark, d):
    return pii.pii_digest(pii.find_pii(_documents(spark, d)))


@query
def op12_vector_codes(spark, d):
    codes = vector_codes.with_label_error(vector_codes.compress(spark.read.parquet(f"{d}/embeddings.parquet")))
    return codes.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _codes_sql(rounds: int) -> str:
    """Rounds of assignment and means, then the final assignment, over rows (vec_id, part, x) of whole components."""
    nearest = """
a{r} AS MATERIALIZED (SELECT row_id, part, entry, d FROM (
    SELECT p.row_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
           row_number() OVER (PARTITION BY p.row_id, p.part ORDER BY d, b.entry) AS n
    FROM parts p JOIN b{r} b USING (part)) WHERE n = 1),"""
    means = """
m{r} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM (
    SELECT part, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v
    FROM a{r} JOIN parts USING (row_id, part), (SELECT unnest(range(1, 100)) AS i) WHERE i <= len(x) GROUP BY part, entry, i) GROUP BY part, entry),
b{next} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.x, b{r}.x) AS x FROM b{r} LEFT JOIN m{r} USING (part, entry)),"""
    steps = "".join(nearest.format(r=r) + means.format(r=r, next=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row_id,
           list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (
    SELECT row_id, CAST(p AS BIGINT) AS part, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x
    FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT part, row_id - 1 AS entry, x FROM parts WHERE row_id <= 64),{steps}
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
codes AS (SELECT row_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (row_id), books
"""


ORACLE["op12_vector_codes"] = _codes_sql(vector_codes.ROUNDS)


@query
def op13_hard_negatives(spark, d):
    changed = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(spark.read.parquet(f"{d}/embeddings.parquet"), lambda i: i % 100 == 0, relabel=changed)


ORACLE["op13_hard_negatives"] = """
WITH rows AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN scores n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5
"""
