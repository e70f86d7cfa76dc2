"""Nearest neighbours by largest inner product: multiprobe p-stable hashing with exact reranking.

Inner products become Euclidean distances by one more component: candidates get ``sqrt(M^2 - |x|^2)`` (M the largest
norm), queries 0. Each of ``tables`` hashes a vector by ``hashes`` values ``floor((a.x + b) / width)``. A query visits
its own buckets and perturbed ones in order of the estimated chance of success (squared distances to the buckets'
borders), over all tables together. Buckets meet queries in blocks: a large bucket is salted over its candidates and its queries go to every
block. A task keeps the best ``k`` per query over all its blocks; tables are merged by pair and ranked once more. A
block's matrix product only chooses; the score of a chosen pair is summed column by column, so that a pair has the same
score to the last bit in every block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelpay.llm.common import Store, splittable

#: Probes are over all tables. See the README for recall and share of candidates by setting.
TABLES, HASHES, WIDTH, PROBES = 24, 8, 2.0, 540
#: Queries whose best rows a task holds before it hands them on.
HELD_QUERIES = 20_000
BLOCK = 4096


def _planes(dim: int, scale: float, tables: int, hashes: int, width: float, seed: int):
    """Directions and offsets; lengths are in units of the largest norm."""
    r = np.random.Generator(np.random.PCG64(seed))
    return r.normal(size=(tables, dim + 1, hashes)) / scale, r.uniform(0, width, (tables, hashes))


def _bucket(table: int, h: np.ndarray) -> np.ndarray:
    out = np.full(h.shape[:-1], np.uint64((table + 1) * 0x9E3779B97F4A7C15 % 2**64))
    for i in range(h.shape[-1]):
        out = (out ^ h[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _hash(dim: int, scale: float, tables: int, hashes: int, width: float, probes: int, seed: int, query: bool):
    schema = pa.schema([("id", pa.int64()), ("buckets", pa.list_(pa.int64()))])
    moves = np.array([m for m in itertools.product((-1, 0, 1), repeat=hashes) if np.abs(m).sum() <= 3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, shifts = _planes(dim, scale, tables, hashes, width, seed)
        for whole in batches:
            for first in range(0, whole.num_rows, 128):
                batch = whole.slice(first, 128)
                x = _matrix(batch.column(1))
                last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, scale * scale - (x * x).sum(1)))
                x = np.column_stack([x, last])
                out, costs = [], []
                for t in range(tables):
                    p = (x @ planes[t] + shifts[t]) / width
                    h = np.floor(p)
                    out.append(_bucket(t, h)[:, None] if not query else h[:, None, :])
                    if query:
                        f = p - h
                        cost = np.zeros((len(x), len(moves)))
                        for j in range(hashes):
                            cost += np.where(moves[:, j] == -1, f[:, [j]] ** 2, np.where(moves[:, j] == 1, (1 - f[:, [j]]) ** 2, 0))
                        costs.append(cost)
                if query:
                    # The likeliest of all tables' buckets; equal costs by table and move.
                    order = np.argsort(np.concatenate(costs, axis=1), axis=1, kind="stable")[:, :probes]
                    table, move = np.divmod(order, len(moves))
                    own = np.concatenate(out, axis=1)
                    h = own[np.arange(len(x))[:, None], table] + moves[move]
                    visited = np.zeros(order.shape, np.int64)
                    for t in range(tables):
                        visited[table == t] = _bucket(t, h[table == t])
                    out = [visited]
                flat = np.concatenate(out, axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=schema)

    return run


def _scores(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the columns, whatever the number of rows (a running sum is never paired)."""
    return np.cumsum(x * query, axis=1)[:, -1]


def _search(k: int):
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        place, queries, vectors = None, [], []

        def handed() -> Iterator[pa.RecordBatch]:
            items = list(best.items())
            best.clear()
            for i in range(0, len(items), 5000):
                part = items[i : i + 5000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([q for q, _ in part], [len(v[0]) for _, v in part])), pa.array(np.concatenate([v[0] for _, v in part])), pa.array(np.concatenate([v[1] for _, v in part]))],
                    schema=schema,
                )

        def block(ids: np.ndarray, x: np.ndarray) -> None:
            q = np.stack(vectors)
            # More than the rounding by which two orders of summation differ.
            slack = 4 * x.shape[1] * np.finfo(np.float64).eps * np.sqrt((x * x).sum(1).max())
            for i in range(0, len(q), 512):
                rough = np.einsum("qd,cd->qc", q[i : i + 512], x, optimize=True)
                for query, vector, row in zip(queries[i : i + 512], q[i : i + 512], rough, strict=True):
                    old_ids, old = best.get(query, (ids[:0], row[:0]))
                    if len(row) > 4 * k:
                        cut = np.partition(row, -2 * k)[-2 * k]
                        some = np.flatnonzero(row >= cut - slack * np.sqrt(vector @ vector))
                        near, vectors_near = ids[some], x[some]
                    else:
                        near, vectors_near = ids, x
                    merged_ids, merged = np.concatenate([old_ids, near]), np.concatenate([old, _scores(vectors_near, vector)])
                    merged_ids, where = np.unique(merged_ids, return_index=True)
                    merged = merged[where]
                    top = np.lexsort((merged_ids, -merged))[: k + 1]
                    best[query] = (merged_ids[top], merged[top])

        for batch in batches:  # sorted by place, queries of a place first
            at, kind, ids, x = (batch.column(i) for i in range(4))
            at, kind, ids, x = at.to_numpy(), kind.to_numpy(), ids.to_numpy(), _matrix(x)
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
                if a == b:
                    continue
                if at[a] != place:
                    place, queries, vectors = at[a], [], []
                if kind[a] == 0:
                    queries.extend(ids[a:b].tolist())
                    vectors.extend(x[a:b])
                elif queries:
                    block(ids[a:b], x[a:b])
            if len(best) > HELD_QUERIES:
                yield from handed()
        yield from handed()

    return run


def nearest(vectors: DataFrame, is_query, *, k: int = 20, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, block: int = BLOCK, seed: int = 9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row where ``is_query`` holds, itself left out.

    Null ids, null or zero vectors and vectors with null or non-finite components take no part. A vector is compared with
    those of its own length. Rows repeating an id are one row (the smallest vector). Ties go to the smaller
    id. Equal vectors are searched once: with k + 1 ids of each distinct vector no result can change. A query that
    finds fewer than ``k`` candidates in its buckets is compared with all rows, so that small tables are exact.
    """
    spark = vectors.sparkSession
    store = Store(spark)
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clean = clean.where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda c: c != 0))
    clean = clean.groupBy("id").agg(F.min("x").alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c))
    rows = store.put(clean.withColumn("norm", norm).withColumn("dim", F.size("x")), "vectors")
    found = None
    # One pass per length of vectors, of which a table has few.
    for dim, scale in rows.groupBy("dim").agg(F.max("norm")).orderBy("dim").collect():
        part = _nearest_of(rows.where(F.col("dim") == dim), dim, scale, is_query, store, k, tables, hashes, width, probes, block, seed, _is_float(vectors, vector_col))
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _nearest_of(rows: DataFrame, dim: int, scale: float, is_query, store: Store, k: int, tables: int, hashes: int, width: float, probes: int, block: int, seed: int, is_float: bool) -> DataFrame:
    """``nearest`` over cleaned rows of one length."""
    first = Window.partitionBy("x").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    distinct = store.put(few.groupBy("x").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "distinct")
    asked = rows.where(is_query("id")).select("x", F.col("id").alias("query_id"))
    asked = store.put(asked.join(splittable(distinct.select("x", "id"), "x"), "x").select("query_id", "id"), "asked")
    query_ids = asked.select("id").distinct()
    heads = distinct.select("id", "x")
    args = (dim, float(scale) * (1 + 1e-9), tables, hashes, width, probes, seed)
    placed = heads.mapInArrow(_hash(*args, False), "id long, buckets array<long>").select("id", F.explode("buckets").alias("bucket"))
    queries = heads.join(query_ids, "id", "left_semi")
    probed = queries.mapInArrow(_hash(*args, True), "id long, buckets array<long>").select("id", F.explode("buckets").alias("bucket")).distinct()
    placed = store.put(placed, "placed")
    blocks = store.put(placed.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")), "blocks")
    salted = splittable(blocks, "bucket")
    c = placed.join(salted, "bucket").select("id", F.xxhash64("bucket", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("place"), F.lit(1).alias("kind"))
    q = probed.join(salted, "bucket").select("id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda s: F.xxhash64("bucket", s))).alias("place"), F.lit(0).alias("kind"))
    float_heads = heads.select("id", F.expr("transform(x, c -> cast(c as float))").alias("v")) if is_float else heads.select("id", F.col("x").alias("v"))
    dealt = c.unionByName(q).join(float_heads, "id").select("place", "kind", "id", "v").repartition("place").sortWithinPartitions("place", "kind")
    found = store.put(_merged(dealt.mapInArrow(_search(k), "query long, id long, score double")), "found")

    def top(best: DataFrame, who: DataFrame) -> DataFrame:
        """Rank once per distinct query vector: k + 1 places leave k beside any query's own row.

        Every vector has one id at least, the one that stands for it and the smallest, so the k + 1 best ids are
        among those of the k + 1 best vectors; only these are expanded into all their ids.
        """
        nearest_first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        best = best.withColumn("place", F.row_number().over(nearest_first)).where(F.col("place") <= k + 1)
        ids = best.join(distinct.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
        places = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        ids = ids.withColumn("place", F.row_number().over(places)).where(F.col("place") <= k + 1)
        own = who.join(ids, F.col("id") == F.col("query")).where("vec_id <> query_id")
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return own.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    result = store.put(top(found, asked), "result")
    enough = min(k, rows.count() - 1)
    short = asked.join(result.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < enough).select("query_id", "id")
    short = store.put(short, "short")
    if short.isEmpty():
        return result
    # Compare the few queries left with every row, in blocks by a hash of the candidate.
    parts = max(1, -(-distinct.count() // block))
    qs = short.select("id").distinct().join(float_heads, "id").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("place"), F.lit(0).alias("kind"), "id", "v")
    cs = float_heads.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("place"), F.lit(1).alias("kind"), "id", "v")
    full = cs.unionByName(qs).repartition("place").sortWithinPartitions("place", "kind").mapInArrow(_search(k), "query long, id long, score double")
    again = top(_merged(full), short)
    return result.join(short, "query_id", "left_anti").unionByName(again)


def _merged(found: DataFrame) -> DataFrame:
    """One row per pair, however many tables and tasks found it."""
    return found.groupBy("query", "id").agg(F.max("score").alias("score"))


def _is_float(vectors: DataFrame, name: str) -> bool:
    return vectors.schema[name].dataType.simpleString() == "array<float>"
