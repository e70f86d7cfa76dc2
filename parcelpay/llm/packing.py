"""Best-fit packing into sequences of several permitted lengths.

Only lengths move: rows (document, piece, length) are dealt by hash into shards of a bounded number of pieces, and each
shard is packed on its own, longest piece first. A piece goes to the open bin it leaves least room in. If none has room,
the bin size with the least cost per token is opened, where the tokens a size would hold are estimated from the lengths
that are still to come. At the end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZES = (512, 1024, 2048, 4096)
SHARD_PIECES = 20_000
#: Equal rows that go to a shard together.
COPIES = 64


def bin_cost(size: int, overhead: float = 32.0, quadratic: float = 1 / 16384) -> float:
    """Cost of one sequence: its tokens, a share that grows with the square (attention), and a fixed part."""
    return overhead + size + quadratic * size * size


def _expected_fill(room: int, counts: dict[int, int], waiting: int) -> int:
    """Tokens that the longest waiting pieces would put into ``room``; ``waiting`` has a bit per waiting length."""
    filled, used = 0, {}
    for _ in range(32):
        fits = waiting & ((1 << (room + 1)) - 1)
        while fits:
            length = fits.bit_length() - 1
            if used.get(length, 0) < counts[length]:
                break
            fits ^= 1 << length
        if not fits or not length:
            break
        take = min(counts[length] - used.get(length, 0), room // length)
        used[length] = used.get(length, 0) + take
        filled, room = filled + take * length, room - take * length
    return filled


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece, and the final size of every bin; no length may exceed the largest size."""
    sizes = tuple(sorted(sizes))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    counts: dict[int, int] = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    waiting = sum(1 << n for n in counts)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # a bit per room that some open bin has
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    capacity: list[int] = []
    held: list[int] = []
    for i in order:
        n = lengths[i]
        counts[n] -= 1
        if not counts[n]:
            waiting ^= 1 << n
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            able = sizes[bisect_left(sizes, n) :]
            size = min(able, key=lambda s: (bin_cost(s) / max(1, n + _expected_fill(s - n, counts, waiting)), s))
            b, room = len(capacity), size
            capacity.append(size)
            held.append(0)
        bins[i], offsets[i] = b, held[b]
        held[b] += n
        by_room.setdefault(room - n, []).append(b)
        rooms |= 1 << (room - n)
    return bins, offsets, [sizes[bisect_left(sizes, h)] for h in held]


def pieces_of(docs: DataFrame, largest: int, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """doc_id, piece, start, length: documents cut into runs of at most ``largest`` tokens.

    Tokens are the words of the text, or as many as ``length_col`` says. Null and empty texts have length 0 and make
    one empty piece, so that every document is placed.
    """
    words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) if length_col is None else F.coalesce(F.col(length_col), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(words.cast("long"), F.lit(0)).alias("_n"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("_n", F.lit(1)) - 1) / largest).cast("long"))))
    start = F.col("piece") * largest
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.col("_n") - start, F.lit(largest)).cast("long").alias("length"))


def best_fit_packing(docs: DataFrame, *, sizes: tuple[int, ...] = SIZES, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, shard, bin, bin_size, bin_offset.

    (shard, bin) names a sequence of ``bin_size`` tokens that holds the piece from ``bin_offset`` on. Shards come from
    a hash of document, piece and length, so that copies of one id spread by content; rows equal in these are counted
    and dealt by ``COPIES`` with a running number. Packing is deterministic for given rows. Other columns are ignored.
    """
    pieces = pieces_of(docs, max(sizes), id_col=id_col, text_col=text_col, length_col=length_col)
    shards = max(1, -(-pieces.count() // shard_pieces))
    equal = pieces.groupBy("doc_id", "piece", "start", "length").agg(F.count("*").alias("n"))
    lots = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES).cast("long"))))
    lots = lots.withColumn("copies", F.least(F.col("n") - F.col("lot") * COPIES, F.lit(COPIES)).cast("long"))
    keyed = lots.select("doc_id", "piece", "start", "length", "copies", F.pmod(F.xxhash64("doc_id", "piece", "length", "lot"), F.lit(shards)).alias("shard"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])].drop(columns="copies").sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, final = pack(pdf["length"].tolist(), sizes)
        return pdf.assign(bin=pd.Series(bins, dtype="int64"), bin_size=pd.Series([final[b] for b in bins], dtype="int64"), bin_offset=pd.Series(offsets, dtype="int64"))

    return keyed.groupBy("shard").applyInPandas(one, "doc_id long, piece long, start long, length long, shard long, bin long, bin_size long, bin_offset long")
