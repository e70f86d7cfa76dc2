"""Hard negatives by vertical scans of columnar blocks (BOND).

Candidates are dealt by a hash into places and kept there by column, in blocks. An anchor reads a block's columns in
descending order of its own components' magnitudes. What the columns not yet read can add to a score lies between sums
of their minima and maxima, taken over the block, so every candidate has a lower and an upper bound at any time. A bitmap
of candidates shrinks as bounds rule rows out; those left are read to the end, and their scores are exact. Components
are whole numbers with scores below 2^53, so sums in doubles are exact in any order.

Two scans follow one another: each anchor's best rows of its own label, then, for the scores of these positives, the best
rows of other labels within each positive's window. Anchors go to every place: a stated query set meets all rows. A place
keeps an anchor's few best rows only while it reads that anchor, and Spark merges the places by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelpay.llm.common import Store, slices, usable, whole_components

#: Sum of squares of a vector's components at most: every score is below 2^52 and a hundred times it fits a long.
ROOM = 2**52
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between LOW / 100 of the positive's and the positive's.
LOW = 80
BLOCK = 4096
#: Rows of a place: as many blocks as leave every core some places, at most PLACE_ROWS.
PLACE_ROWS = 131_072
#: Columns read between two looks at the bounds.
STEP = 8


class Block:
    """Candidates of one length by column, with the least and greatest value of every column."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels = ids, labels
        self.columns = np.ascontiguousarray(x.T, np.float64)
        self.least, self.greatest = self.columns.min(1), self.columns.max(1)


def _vertical(block: Block, anchor: np.ndarray, rows: np.ndarray, shrink: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the bitmap that ``shrink`` leaves by their bounds, step by step, and their exact scores."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    a = anchor[order]
    low, high = a * block.least[order], a * block.greatest[order]
    # What the columns from some place of the order on can add at least and at most.
    least = np.append(np.cumsum(np.minimum(low, high)[::-1])[::-1], 0.0)
    most = np.append(np.cumsum(np.maximum(low, high)[::-1])[::-1], 0.0)
    partial = np.zeros(len(rows))
    whole = len(rows) == len(block.ids)
    for first in range(0, len(a), STEP):
        last = min(first + STEP, len(a))
        part = block.columns[order[first:last]]
        partial += a[first:last] @ (part if whole else part[:, rows])
        kept = shrink(partial + least[last], partial + most[last])
        if not kept.all():
            rows, partial, whole = rows[kept], partial[kept], False
            if not len(rows):
                break
    return rows, partial


def _kth(values: np.ndarray, k: int) -> float:
    return -np.inf if len(values) < k else np.partition(values, -k)[-k]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by score, ties by the smaller id."""
    if len(ids) > k:
        some = scores >= _kth(scores, k)
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def best_positives(blocks: list[Block], anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best rows of the anchor's label, itself left out."""
    ids, scores = np.empty(0, np.int64), np.empty(0)
    for block in blocks:
        rows = np.flatnonzero((block.labels == label) & (block.ids != anchor_id))
        floor = _kth(scores, k)
        found, exact = _vertical(block, anchor, rows, lambda low, high, floor=floor: high >= max(floor, _kth(low, k)))
        ids, scores = _best(np.append(ids, block.ids[found]), np.append(scores, exact), k)
    return ids, scores


def best_in_windows(blocks: list[Block], label: int, anchor: np.ndarray, tops: list[int], k: int, low: int = LOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each positive score: ids and scores of the best rows of other labels within its window."""
    tops_ = np.array(tops, np.float64)
    floors = np.array([-(-low * t // 100) for t in tops], np.float64)  # the least whole score in the window
    held = [(np.empty(0, np.int64), np.empty(0)) for _ in tops]
    for block in blocks:
        rows = np.flatnonzero(block.labels != label)
        least = np.array([max(f, _kth(s, k)) for f, (_, s) in zip(floors, held, strict=True)])

        def shrink(lower: np.ndarray, upper: np.ndarray, least: np.ndarray = least) -> np.ndarray:
            kept = np.zeros(len(lower), bool)
            for w, top in enumerate(tops_):
                possible = (upper >= least[w]) & (lower <= top)
                if possible.any():
                    # k rows that are surely inside raise what another row must reach.
                    sure = lower[possible & (lower >= floors[w]) & (upper <= top)]
                    kept |= possible & (upper >= _kth(sure, k))
            return kept

        found, exact = _vertical(block, anchor, rows, shrink)
        for w, top in enumerate(tops_):
            inside = (exact >= floors[w]) & (exact <= top)
            ids, scores = held[w]
            held[w] = _best(np.append(ids, block.ids[found[inside]]), np.append(scores, exact[inside]), k)
    return held


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_FOUND = pa.schema([("anchor_id", pa.int64()), ("top", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _scan(answer: Callable[[list[Block], int, int, np.ndarray, list[int]], Iterator[tuple]], block: int):
    """Reads rows sorted by place, candidates first: keeps the blocks of one place and answers its anchors one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, blocks, pending, held, out = None, [], [], 0, []

        def close() -> None:
            nonlocal pending, held
            if pending:
                blocks.append(Block(*(np.concatenate(c) for c in zip(*pending, strict=True))))
                pending, held = [], 0

        for batch in batches:
            for part in slices(batch, 4):
                at, kind, ids, labels, lists, tops = (part.column(i) for i in range(6))
                at, kind, ids, labels = (c.to_numpy() for c in (at, kind, ids, labels))
                cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
                for a, b in zip([0, *cut], [*cut, len(at)], strict=True):
                    if at[a] != place:
                        place, blocks, pending, held = at[a], [], [], 0
                    x = _matrix(lists.slice(a, b - a))
                    if kind[a] == 0:
                        for i in range(a, b, block):
                            j = min(b, i + block)
                            pending.append((ids[i:j], labels[i:j], x[i - a : j - a]))
                            held += j - i
                            if held >= block:
                                close()
                        continue
                    close()
                    for i in range(a, b):
                        out.extend(answer(blocks, int(ids[i]), int(labels[i]), x[i - a].astype(np.float64), tops[i].as_py()))
                    if len(out) > 20_000:
                        yield _rows(out)
                        out = []
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_FOUND)


def _positives(k: int):
    def answer(blocks, anchor_id, label, anchor, tops):
        ids, scores = best_positives(blocks, anchor_id, label, anchor, k)
        return ((anchor_id, 0, i, s) for i, s in zip(ids.tolist(), scores.astype(np.int64).tolist(), strict=True))

    return answer


def _negatives(k: int, low: int):
    def answer(blocks, anchor_id, label, anchor, tops):
        found = best_in_windows(blocks, label, anchor, tops, k, low)
        return ((anchor_id, t, i, s) for t, (ids, scores) in zip(tops, found, strict=True) for i, s in zip(ids.tolist(), scores.astype(np.int64).tolist(), strict=True))

    return answer


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of every anchor and window over all places; ranks are cut before rows meet."""
    order = Window.partitionBy("anchor_id", "top").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], *, relabel: Callable[[Column, Column], Column] | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, block: int = BLOCK, place_rows: int = PLACE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of whole components floor(256 * x). An anchor's positives are its ``positives`` best other
    rows of its label; a positive's negatives are the ``negatives`` best rows of other labels with ``low`` / 100 of the
    positive's score at least and its score at most. Ties go to the smaller id; a positive with equal score shares its
    window. A positive without negatives has no row.

    Null ids, labels and vectors and vectors with null or non-finite components take no part. Rows repeating an id are
    one row (the smallest vector, then the smallest label). Vectors are compared with those of their own length; empty
    ones take no part. Components beyond +-2^26 / sqrt(length) after scaling are taken to that bound. Other columns are
    ignored, whatever their names. ``relabel`` gets id and label and gives the label that counts.
    """
    spark = vectors.sparkSession
    store = Store(spark)
    i, l = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    clean = vectors.where(i.isNotNull() & l.isNotNull() & usable(vector_col)).where(F.size(vector_col) > 0)
    clean = clean.select(i.alias("id"), (relabel(i, l) if relabel else l).cast("long").alias("label"), whole_components(vector_col, ROOM).cast("array<int>").alias("x"))
    single = clean.groupBy("id").agg(F.min(F.struct("x", "label")).alias("row"))
    rows = store.put(single.select("id", "row.label", "row.x").where("label is not null"), "rows")
    cores = max(1, spark.sparkContext.defaultParallelism)
    sizes = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows"))
    per_place = F.least(F.greatest(F.lit(block), F.ceil(F.col("rows") / (2 * cores))), F.lit(max(block, place_rows)))
    sizes = store.put(sizes.select("n", F.ceil(F.col("rows") / per_place).cast("long").alias("places")), "sizes")

    def dealt(anchors: DataFrame) -> DataFrame:
        """Candidates in their places, and a copy of every anchor for each place of its length."""
        columns = ("id", "label", "x", "tops")
        n, places = F.size("x"), F.col("places")
        no_tops = F.array().cast("array<long>").alias("tops")
        c = rows.join(sizes, n == F.col("n")).select(F.xxhash64("n", F.pmod(F.xxhash64("id"), places)).alias("place"), F.lit(0).alias("kind"), "id", "label", "x", no_tops)
        every = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), places - 1), lambda p: F.xxhash64("n", p))).alias("place")
        a = anchors.join(sizes, n == F.col("n")).select(every, F.lit(1).alias("kind"), *columns)
        return c.unionByName(a).repartition("place").sortWithinPartitions("place", "kind").select("place", "kind", *columns)

    schema = "anchor_id long, top long, id long, score long"
    anchors = rows.where(is_anchor(F.col("id")))
    found = dealt(anchors.withColumn("tops", F.array().cast("array<long>"))).mapInArrow(_scan(_positives(positives), block), schema)
    pos = store.put(_first(found, positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # No score lies between a negative number's share and itself, so such positives have no window.
    tops = pos.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_set("positive_score")).alias("tops"))
    asked = anchors.join(tops, "id").select("id", "label", "x", "tops")
    found = dealt(asked).mapInArrow(_scan(_negatives(negatives, low), block), schema)
    neg = _first(found, negatives).select("anchor_id", F.col("top").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pos.join(neg, ["anchor_id", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
