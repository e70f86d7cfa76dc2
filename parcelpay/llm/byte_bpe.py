"""Byte-level BPE by rank files: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

The vocabulary's byte strings are placed by hash and displace: every bucket of keys has a displacement that sends its
keys to free slots, so a lookup is two hashes and one comparison of complete bytes, and the table has one slot per key.
A pre-token that is no key is merged from single bytes: neighbours are linked by index and a heap gives the pair of
least rank, leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.llm.common import slices, text_or_empty

#: Characters of cached pieces, cuts and their ids that a worker holds at most.
CACHE_BYTES = 256 << 20
_ODD_SPACE = re.compile(r" (?=\s|\Z)")
_codecs: dict[tuple[str, str], "ByteBpe"] = {}


class PerfectHash:
    """Minimal perfect hash from byte strings to their ids; -1 for any other string."""

    def __init__(self, ranks: dict[bytes, int], per_bucket: int = 4):
        n = len(ranks)
        self.n, self.buckets = n, max(1, -(-n // per_bucket))
        self.keys: list[bytes] = [b""] * n
        self.ids = [-1] * n
        self.shift = [0] * self.buckets
        groups: dict[int, list[bytes]] = {}
        for key in ranks:
            groups.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(key)
        taken, free = bytearray(n), 0
        for bucket in sorted(groups, key=lambda b: -len(groups[b])):
            members = groups[bucket]
            if len(members) == 1:  # goes to the next free slot, named directly
                while taken[free]:
                    free += 1
                places, self.shift[bucket] = [free], -1 - free
            else:
                d = 1
                while True:
                    places = [xxhash.xxh3_64_intdigest(k, d) % n for k in members]
                    if len(set(places)) == len(places) and not any(taken[p] for p in places):
                        break
                    d += 1
                self.shift[bucket] = d
            for p, key in zip(places, members, strict=True):
                taken[p], self.keys[p], self.ids[p] = 1, key, ranks[key]

    def get(self, key: bytes) -> int:
        if not self.n:
            return -1
        d = self.shift[xxhash.xxh3_64_intdigest(key) % self.buckets]
        p = -1 - d if d < 0 else xxhash.xxh3_64_intdigest(key, d) % self.n
        return self.ids[p] if self.keys[p] == key else -1


class ByteBpe:
    def __init__(self, path: str, pattern: str, cache_bytes: int = CACHE_BYTES):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.table = PerfectHash(self.ranks)
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for b, i in self.ranks.items():
            self.bytes_of[i] = b
        # All vocabulary bytes by id in one array, for decoding whole arrays of ids.
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes_of]))).astype(np.int64)
        self.pattern = regex.compile(pattern)
        self.cache_bytes, self.held = cache_bytes, 0
        self.pieces: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}  # cuts that follow a blank, without it; the ids are those with the blank

    def merge(self, token: bytes) -> tuple[int, ...]:
        """Ids of a pre-token by lowest-rank merges over linked bytes."""
        ranks, n = self.ranks, len(token)
        end = list(range(1, n + 1))  # end of the part that starts here
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue  # one of the two parts has been merged since
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(token[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (p := before[i]) >= 0 and (r := ranks.get(token[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = after[i]
        return tuple(out)

    def _keep(self, cache: dict[str, bytes], text: str, ids: bytes) -> None:
        """Results of short strings, up to a bound in bytes (with about 200 for the objects); then both start anew."""
        if len(text) > 64:
            return
        size = 200 + 2 * len(text) + len(ids)
        if self.held + size > self.cache_bytes:
            self.pieces.clear()
            self.after.clear()
            self.held = 0
        self.held += size
        cache[text] = ids

    def _ids(self, piece: str) -> bytes:
        token = piece.encode()
        whole = self.table.get(token)
        return np.array((whole,) if whole >= 0 else self.merge(token), "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self._ids(piece)
            self._keep(self.pieces, piece, got)
        return got

    def _matched(self, text: str) -> bytes:
        return b"".join([self._piece(piece) for piece in self.pattern.findall(text)])

    def _after(self, cut: str) -> bytes:
        got = self.after.get(cut)
        if got is None:
            pieces = self.pattern.findall(" " + cut)
            # A cut that is one piece is held once.
            got = self._ids(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece, pieces))
            self._keep(self.after, cut, got)
        return got

    def encode_bytes(self, text: str) -> bytes:
        """Ids of each match of the pattern in turn, as little-endian unsigned 32-bit integers.

        A blank before a character that is no white space always starts a match, so a text is cut there and equal
        cuts are encoded once; a text with other blanks is matched whole.
        """
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._matched(text)
        first, *rest = text.split(" ")
        start = self._matched(first)
        try:
            return start + b"".join(map(self.after.__getitem__, rest))
        except KeyError:
            return start + b"".join(map(self._after, rest))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The bytes that ids stand for, copied from the vocabulary's array."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        first, sizes = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)].tobytes()


def codec(path: str, pattern: str) -> ByteBpe:
    """The codec of a rank file, built once per Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBpe(path, pattern)
    return _codecs[path, pattern]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def encode_texts(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every whole text; null counts as empty, other columns are ignored.

    The rank file must be at the same path on every executor. Empty texts have no ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, max_bytes=1 << 20):
                ids = [np.frombuffer(bpe.encode_bytes(t), np.int32) for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes they stand for; null ids give no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, max_bytes=1 << 20):
                lists = part.column(1)
                offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                texts = [bpe.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids (as little-endian unsigned 32-bit integers) and of what they decode to.

    One pass: a text is encoded, its ids are decoded, and only the hashes leave the worker. Rows as in ``encode_texts``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, max_bytes=1 << 20):
                n, sha, back = [], [], []
                for text in part.column(1).to_pylist():
                    ids = bpe.encode_bytes(text)
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
