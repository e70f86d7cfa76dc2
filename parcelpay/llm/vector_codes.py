"""Product codes of vectors, with an Orchard search for the nearest codebook entry.

Components are whole numbers, so every distance, tie and mean is exact on any number of tasks. A vector is cut into
consecutive parts; each place has a codebook of its own. For every entry the other entries are listed by distance from
it. A search starts at an entry near by its first component and reads the current entry's list; an entry that is nearer
(or as near with a smaller index) becomes the current one and its list is read instead. Entries met are marked and not
measured again. A list need not be read beyond twice the current distance: by the triangle inequality nothing there is
as near. All vectors of a slice step together.

Codebooks are refined by rounds of assignment and means. A round is one scan: tasks return sums and counts by entry, and
Spark adds them up, so the driver only ever holds the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.llm.common import Store, slices, splittable, usable, whole_components

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Sum of squares of a vector's components at most, so that four times a squared distance fits a long.
ROOM = 2**58
#: Codebook components sent to tasks at a time; vectors of further lengths are coded in another pass.
MODEL_COMPONENTS = 4 << 20


@dataclass
class Codebook:
    """Entries of one place, with each entry's other entries and their squared distances, nearest first."""

    entries: np.ndarray
    order: np.ndarray
    spread: np.ndarray
    starts: np.ndarray
    by_first: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> "Codebook":
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        order = np.argsort(apart, axis=1, kind="stable")
        first = entries[:, 0] if entries.shape[1] else np.zeros(len(entries), np.int64)
        by_first = np.argsort(first, kind="stable")
        return cls(entries, order, np.take_along_axis(apart, order, axis=1), first[by_first], by_first)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, ties to the smaller index, and its squared distance."""
        n, size = len(x), len(self.entries)
        if x.shape[1]:
            current = self.by_first[np.minimum(np.searchsorted(self.starts, x[:, 0]), size - 1)]
        else:
            current = np.zeros(n, np.int64)
        best = ((x - self.entries[current]) ** 2).sum(1)
        met = np.zeros((n, size), bool)
        met[np.arange(n), current] = True
        place = np.zeros(n, np.int64)
        rows = np.arange(n)
        while True:
            rows = rows[place[rows] < size]
            # Twice the distance is four times its square; what lies at exactly that distance may still tie.
            rows = rows[self.spread[current[rows], place[rows]] <= 4 * best[rows]]
            if not len(rows):
                return current, best
            other = self.order[current[rows], place[rows]]
            place[rows] += 1
            new = ~met[rows, other]
            at, other = rows[new], other[new]
            met[at, other] = True
            d = ((x[at] - self.entries[other]) ** 2).sum(1)
            nearer = (d < best[at]) | ((d == best[at]) & (other < current[at]))
            at, other, d = at[nearer], other[nearer], d[nearer]
            current[at], best[at], place[at] = other, d, 0


def cuts(length: int, parts: int = PARTS) -> list[int]:
    """Borders of the parts; a length that the parts do not divide leaves one component more to each of the first."""
    return [0, *np.cumsum([length // parts + (p < length % parts) for p in range(parts)]).tolist()]


@dataclass
class Codebooks:
    """Codebooks by part for every vector length."""

    parts: int
    by_length: dict[int, list[np.ndarray]]

    def digest(self, length: int) -> str:
        """Hash of all components as decimals by part, entry and place within the part."""
        numbers = (str(c) for book in self.by_length[length] for entry in book.tolist() for c in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def searchers(self) -> dict[int, list[Codebook]]:
        return {n: [Codebook.of(b) for b in books] for n, books in self.by_length.items()}


def _rows_by_length(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vector length, row numbers and matrix for each length in the slice."""
    lists = part.column(1)
    offsets = lists.offsets.to_numpy()
    lengths, values = np.diff(offsets), lists.values.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield int(n), rows, values[offsets[rows][:, None] + np.arange(n)[None, :]].astype(np.int64)


def _sums(shared):
    """Per task: count and component sums of the vectors' parts by length, part and entry."""
    schema = pa.schema([("length", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        searchers, state = books.searchers(), {}
        for batch in batches:
            for part in slices(batch, 1):
                for length, _, x in _rows_by_length(part):
                    border = cuts(length, books.parts)
                    for p, book in enumerate(searchers[length]):
                        own = x[:, border[p] : border[p + 1]]
                        entry, _ = book.nearest(own)
                        n, total = state.setdefault((length, p), (np.zeros(len(book.entries), np.int64), np.zeros_like(book.entries)))
                        n += np.bincount(entry, minlength=len(n))
                        np.add.at(total, entry, own)
        rows = [(length, p, e, int(n[e]), total[e].tolist()) for (length, p), (n, total) in state.items() for e in np.flatnonzero(n).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _assign(shared):
    schema = pa.schema([("vec_id", pa.int64()), ("code", pa.string()), ("error", pa.int64()), ("codebooks_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        searchers, digests = books.searchers(), {n: books.digest(n) for n in books.by_length}
        width = 1 if max((len(b) for lists in books.by_length.values() for b in lists), default=0) <= 256 else 2
        for batch in batches:
            for part in slices(batch, 1):
                code = np.zeros((part.num_rows, books.parts), ">u2" if width == 2 else np.uint8)
                error, sha = np.zeros(part.num_rows, np.int64), np.empty(part.num_rows, object)
                for length, rows, x in _rows_by_length(part):
                    border = cuts(length, books.parts)
                    sha[rows] = digests[length]
                    for p, book in enumerate(searchers[length]):
                        code[rows, p], d = book.nearest(x[:, border[p] : border[p + 1]])
                        error[rows] += d
                text = pa.array([row.tobytes().hex() for row in code], pa.string())
                columns = [part.column(0), text, pa.array(error), pa.array(sha, pa.string()), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, *part.schema.names[2:]])

    return run


def _smallest(entries: int):
    """Per task and length: the vectors of the smallest ids, null ids last; of a repeated id the smallest vector."""
    schema = pa.schema([("n", pa.int32()), ("id", pa.int64()), ("x", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple[bool, int], list[int]]] = {}
        last: dict[int, tuple[bool, int]] = {}
        for batch in batches:
            for part in slices(batch, 1):
                for i, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    n, key = len(x), (i is None, i or 0)
                    if n in last and key > last[n]:
                        continue
                    mine, vector = held.setdefault(n, {}), x.as_py()
                    mine[key] = min(mine.get(key, vector), vector)
                    if len(mine) > 2 * entries:
                        held[n] = mine = dict(sorted(mine.items())[:entries])
                        last[n] = max(mine)
        rows = [(n, None if key[0] else key[1], x) for n, mine in held.items() for key, x in sorted(mine.items())[:entries]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def whole_vectors(vectors: DataFrame, *more: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x array<int> of whole components, and further columns as _0, _1, ...; rows without a usable vector go."""
    kept = vectors.where(usable(vector_col))
    x = whole_components(vector_col, ROOM).cast("array<int>").alias("x")
    return kept.select(F.col(id_col).cast("long").alias("id"), x, *[F.col(c).alias(f"_{i}") for i, c in enumerate(more)])


def _lots(rows: DataFrame, entries: int, parts: int) -> list[list[int]]:
    """Vector lengths in the table, in lots whose codebooks one pass may hold; one lot, but for very many lengths."""
    lots: list[list[int]] = []
    held = MODEL_COMPONENTS
    for (n,) in rows.select(F.size("x").alias("n")).distinct().orderBy("n").collect():
        if held + (n + parts) * entries > MODEL_COMPONENTS:
            lots.append([])
            held = 0
        lots[-1].append(n)
        held += (n + parts) * entries
    return lots


def train_codebooks(rows: DataFrame, lengths: list[int], *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``whole_vectors`` rows of the given lengths, from the vectors of the smallest ids and refined."""
    heads = rows.select("id", "x").mapInArrow(_smallest(entries), "n int, id long, x array<int>")
    heads = Store(rows.sparkSession).put(heads.groupBy("n", "id").agg(F.min("x").alias("x")), "heads")
    by_length = {}
    for n in lengths:
        few = heads.where(F.col("n") == n).orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()
        x, border = np.array([r["x"] for r in few], np.int64).reshape(len(few), n), cuts(n, parts)
        by_length[n] = [x[:, a:b].copy() for a, b in zip(border[:-1], border[1:], strict=True)]
    model = Codebooks(parts, by_length)
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(model)
        sums = rows.select("id", "x").mapInArrow(_sums(shared), "length int, part int, entry int, n long, total array<long>")
        flat = sums.select("length", "part", "entry", "n", F.posexplode("total").alias("place", "value"))
        added = flat.groupBy("length", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        model = Codebooks(parts, {n: [b.copy() for b in books] for n, books in model.by_length.items()})
        for r in added.collect():
            model.by_length[r["length"]][r["part"]][r["entry"], r["place"]] = r["value"] // r["n"]
    return model


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, code, error, codebooks_sha256 and the further columns of ``whole_vectors`` rows."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    more = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("id", "x")]
    return rows.mapInArrow(_assign(shared), ", ".join(["vec_id long", "code string", "error long", "codebooks_sha256 string", *more]))


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, codebooks_sha256 and label of every row with a usable vector.

    Vectors that are null or hold null or non-finite components are left out. Each length has codebooks of its own, so
    a vector of an odd length changes nothing for the others; an empty one has code zeros and error 0. With fewer ids
    than entries a codebook is shorter. Null ids come last among the starting vectors; a repeated id starts one entry
    (its smallest vector), while all its rows are coded and counted. Components beyond +-2^29 / sqrt(length) after
    scaling are taken to that bound. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    store = Store(vectors.sparkSession)
    rows = store.put(whole_vectors(vectors, label_col, id_col=id_col, vector_col=vector_col), "whole")
    coded = None
    for lengths in _lots(rows, entries, parts):
        mine = rows.where(F.size("x").isin(lengths))
        part = encode(mine, train_codebooks(mine, lengths, parts=parts, entries=entries, rounds=rounds))
        coded = part if coded is None else coded.unionByName(part)
    if coded is None:
        coded = encode(rows, Codebooks(parts, {}))
    return store.put(coded.withColumnRenamed("_0", "label"), "codes")


def with_label_error(codes: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows with the same label, nulls together; null where no long can hold it."""
    sums = codes.groupBy(F.col("label").alias("k")).agg(F.try_sum("error").alias("label_error"))
    sums = splittable(Store(codes.sparkSession).put(sums, "labels"), "k")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("k")), "left").drop("k")


def reconstruct(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the vector array<double> that its code stands for; codes of 256 entries at most."""
    shared, parts = codes.sparkSession.sparkContext.broadcast(books), books.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_digest = {shared.value.digest(n): shared.value.by_length[n] for n in shared.value.by_length}
        for batch in batches:
            out = []
            for code, sha in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                entries, lists = bytes.fromhex(code), by_digest[sha]
                out.append(np.concatenate([lists[p][entries[p]] for p in range(parts)]) / 256)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "vector"])

    return codes.select("vec_id", "code", "codebooks_sha256").mapInArrow(run, "vec_id long, vector array<double>")
