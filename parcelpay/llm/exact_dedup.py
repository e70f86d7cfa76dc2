"""Exact deduplication by Grace hashing: equal texts meet in one bucket, where an open-addressing table compares
complete content; what a bounded table cannot take is dealt again by another hash until every bucket fits.

The spill files between levels are Spark's own shuffles and tables in the shared folder, so a lost executor costs a
recomputed task. Each map task first collapses its own equal texts, so a group of copies sends its content once per
task, however large it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.llm.common import WHITE, Store, text_or_empty

TABLE_BYTES = 64 << 20
#: No more buckets than give each this many bytes.
LEAST_BUCKET = 1 << 20


class ContentTable:
    """Open addressing with linear probing over complete contents, bounded by the bytes it holds."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[int] = []
        self.slots = [-1] * 1024

    def find(self, digest: bytes, content: bytes) -> int:
        """Entry with this content, or -1 - slot of the free place for it."""
        h, mask = int.from_bytes(digest[:8], "little"), len(self.slots) - 1
        i = h & mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            i = (i + 1) & mask
        return -1 - i

    def has_room(self, content: bytes) -> bool:
        return not self.contents or self.held + len(content) + 100 <= self.limit

    def add(self, slot: int, digest: bytes, content: bytes, value: int) -> None:
        self.slots[slot] = len(self.contents)
        self.hashes.append(int.from_bytes(digest[:8], "little"))
        self.contents.append(content)
        self.values.append(value)
        self.held += len(content) + 100
        if 2 * len(self.contents) > len(self.slots):
            mask = 2 * len(self.slots) - 1
            self.slots = [-1] * (mask + 1)
            for e, h in enumerate(self.hashes):
                i = h & mask
                while self.slots[i] >= 0:
                    i = (i + 1) & mask
                self.slots[i] = e


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def _collapse(limit: int, digest: Callable[[bytes], bytes]):
    schema = pa.schema([("doc", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.binary()), ("row", pa.int64()), ("rep", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, table = TaskContext.get().partitionId() << 40, ContentTable(limit)
        for batch in batches:
            shas, rows, reps, contents = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                content = text.translate(None, WHITE)
                sha = digest(content)
                e = table.find(sha, content)
                if e < 0 and not table.has_room(content):
                    table = ContentTable(limit)
                    e = table.find(sha, content)
                if e < 0:
                    table.add(-1 - e, sha, content, row)
                    contents.append(content)
                    reps.append(row)
                else:
                    contents.append(None)
                    reps.append(table.values[e])
                shas.append(sha)
                rows.append(row)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.utf8_length(batch.column(1)).cast(pa.int64()), pa.array(shas, pa.binary()), pa.array(rows, pa.int64()), pa.array(reps, pa.int64()), pa.array(contents, pa.binary())],
                schema=schema,
            )

    return run


def _settle(limit: int, level: int):
    schema = pa.schema([("rep", pa.int64()), ("sha", pa.binary()), ("variant", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, same = ContentTable(limit), {}
        for batch in batches:
            variants, over = [], []
            for sha, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                e = table.find(sha, content)
                if e < 0 and not table.has_room(content):
                    variants.append(None)
                    over.append(content)
                    continue
                if e < 0:
                    # Different contents of one digest get different variants of it.
                    nth = same.get(sha, 0)
                    same[sha] = nth + 1
                    table.add(-1 - e, sha, content, (level << 32) + nth)
                    e = len(table.values) - 1
                variants.append(table.values[e])
                over.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(variants, pa.int64()), pa.array(over, pa.binary())], schema=schema)

    return run


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``; null text counts as empty, and all
    empty texts are one group. Of equal texts the longest original in code points stays, then the smallest id (null ids
    last); of rows repeating that id too, exactly one is kept. Other columns are ignored. ``table_bytes`` bounds each
    table in memory; what does not fit goes to another level, whatever the input.
    """
    store = Store(docs.sparkSession)
    rows = store.put(
        docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text")).mapInArrow(
            _collapse(table_bytes, digest), "doc long, n_chars long, sha binary, row long, rep long, content binary"
        ),
        "rows",
    )
    left = rows.where("content is not null").select("rep", "sha", "content")
    settled, level = None, 0
    while True:
        # As many buckets as the bytes left need at half a table each, whatever the session's number of partitions.
        held = left.agg(F.sum(F.length("content") + 100)).first()[0] or 0
        buckets = max(1, -(-2 * held // max(table_bytes, LEAST_BUCKET)))
        several = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        deal = F.xxhash64("sha", F.lit(level))
        dealt = left.repartition(int(buckets), deal) if buckets > several else left.repartition(deal)
        out = store.put(dealt.mapInArrow(_settle(table_bytes, level), "rep long, sha binary, variant long, content binary"), f"level{level}")
        done = out.where("content is null").select("rep", "variant")
        settled = done if settled is None else settled.unionByName(done)
        left = out.where("content is not null").select("rep", "sha", "content")
        if left.isEmpty():
            break
        level += 1

    members = rows.select("doc", "n_chars", "sha", "row", "rep")
    other = settled.where("variant <> 0")
    if other.isEmpty():
        members = members.withColumn("variant", F.lit(0).cast("long"))
    else:
        members = members.join(other, "rep", "left").withColumn("variant", F.coalesce("variant", F.lit(0).cast("long")))
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc").isNull().alias("no_id"), "doc", "row")).alias("best")
    groups = members.groupBy(F.struct("sha", "variant").alias("k")).agg(F.count("*").alias("group_size"), best)
    groups = groups.select(F.col("k.sha").alias("sha"), F.col("k.variant").alias("variant"), "group_size", F.col("best.doc").alias("keep_id"), F.col("best.row").alias("keep_row"))
    return members.join(groups, ["sha", "variant"]).select(
        F.col("doc").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
