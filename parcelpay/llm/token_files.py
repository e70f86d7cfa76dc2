"""Token ids in ORC: ascending document ids, run-length encoded integers, row indexes and Bloom filters.

Documents are dealt into id ranges before they are encoded, so the sampling of the ranges never runs the tokenizer, and
each task encodes and writes its range in order. Readers split files at stripes; a filter on ``doc_id`` skips files and
stripes by their minima and maxima, then row groups by index and Bloom filter.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelpay.llm.common import text_or_empty

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
CACHE_WORDS = 600_000
# White space other than blank, tab and line ends: such texts are encoded whole.
_RARE_WHITE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_PLAIN = re.compile("[ \t\r\n!-~\u00c0-\u012f\u0132-\u017e]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_encoders: dict[str, "WordEncoder"] = {}


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


class _Memory(dict):
    """Results by key, made when first asked for; emptied when full."""

    def __init__(self, make: Callable[[str], bytes], room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.room:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _plain(text: str) -> bool:
    """Composed Latin text: lower-casing is all the normalizer does to it, and blanks and pieces never join."""
    return _PLAIN.fullmatch(text) is not None and "<|" not in text and unicodedata.is_normalized("NFC", text)


class WordEncoder:
    """A tokenizer asked once for each distinct piece of plain texts, and for each distinct word of others.

    The memory of ids (int32 bytes) is bounded and never changes an id. Words that are not plain are no pieces of plain
    texts, so both share it.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Memory(self._make, cache_words)

    def _make(self, key: str) -> bytes:
        if _plain(key):
            spelled = key if key.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, key.encode()))
            return array("i", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
        return array("i", self._ids(key)).tobytes()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        if _RARE_WHITE.search(text):
            return np.array(self._ids(text), np.int32)
        if _plain(text):
            keys = _PIECES.findall(text.lower())
        else:
            keys = [k for w in text.split() for k in (_PIECES.findall(w.lower()) if _plain(w) else (w,))]
        return np.frombuffer(b"".join(map(self.known.__getitem__, keys)), np.int32)


def _encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start, end = _encoder(path), 0, np.array([end_id], np.int32)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                ids = [x for t in part.column(1).to_pylist() for x in (encoder.encode(t), end)]
                lengths = np.array([len(ids[i]) + 1 for i in range(0, len(ids), 2)], np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + offsets[:-1], pa.int64()), pa.array(lengths, pa.int32()), lists], schema=schema)
                start += int(offsets[-1])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row, as the token files have them: the ids of the whole text (null: empty) and the
    end id. The ids themselves are not kept. Other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                n = [len(encoder.encode(t)) + 1 for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), append ``end_id`` and write doc_id, part_start, n_tokens and ids.

    Rows are in ascending order of id, null ids first; rows repeating an id are ordered by their text's hash. Other
    columns are not written. ``part_start`` counts the ids before a document in its own file. The tokenizer file must be
    at the same path on every executor.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")
    ordered.mapInArrow(_encode(tokenizer, end_id), "doc_id long, part_start long, n_tokens int, ids array<int>").write.options(**ORC_OPTIONS).orc(path)


_FILES = "doc_id long, part_start long, n_tokens int, ids array<int>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Rows with the task that wrote them: a task's files follow one another, and its starts count over all of them."""
    task = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    return spark.read.schema(_FILES).orc(path).withColumn("task", task)


def _with_start(files: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``start`` from the ids that earlier tasks have in all; tasks are ordered by their number, as the ranges are."""
    sizes = files.groupBy("task").agg(F.sum("n_tokens").alias("size"))
    # One row per writing task.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("task", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    start = (F.col("base") + F.col("part_start")).cast("long").alias("start")
    return rows.join(bases, "task").select("doc_id", start, *columns)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents in the files with ``start``, the number of ids before each in the whole corpus."""
    files = _files(spark, path)
    return _with_start(files, files, "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first columns, and length and checksum of the ids in the last one."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        n = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n, pa.array(crc, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """``token_digest`` of whole files: ids become a checksum where they are read, and only narrow rows meet the bases."""
    files = _files(spark, path)
    rows = files.select("doc_id", "part_start", "task", "ids").mapInArrow(_digest, "doc_id long, part_start long, task long, n_tokens long, ids_crc32 long")
    return _with_start(files, rows, "n_tokens", "ids_crc32")
