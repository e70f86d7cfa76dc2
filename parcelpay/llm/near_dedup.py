"""Near duplicates: b-bit MinHash signatures, joined by a multi-index Hamming join and confirmed on full sets.

A signature has ``chunks * WIDTH`` symbols of 8 bits. Two signatures that differ in at most ``2 * chunks - 1`` symbols
differ in at most one symbol of some chunk (pigeonhole), so every chunk gives ``WIDTH`` keys, each without one of
its symbols: all placements of the one allowed error. Any pair within the distance shares a key.

Documents with equal sets are one class before that. In each bucket every class is compared with the smallest one;
confirmed links give components. What is left are buckets whose members are in different components. Those with the same
smallest class are one family, so that two classes rarely meet more than once, however many keys they share. A place
holds the full sets of its classes, tests pairs of different components and joins them as links are found: it emits
the links that join two components, fewer than it has members, and no link inside a bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelpay.llm.common import WHITE, Store, batch_rows, slices, splittable, text_or_empty
from parcelpay.llm.components import components

WIDTH = 6
MAP_BITS = 1024
MAP_WORDS = MAP_BITS // 64
#: Classes, and bytes of their sets, in a block of a family; two blocks meet in a place.
BLOCK, BLOCK_BYTES = 2048, 24 << 20
#: Rows of sets that are sent to Python at a time.
SET_ROWS = 256
CACHE_WORDS = 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ONE_SPACE = bytes(32 if c in WHITE else c for c in _LOWER)
_random = np.random.Generator(np.random.PCG64(20))
_MULTIPLY = _random.integers(1, 2**63, 24 * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, 24 * WIDTH, dtype=np.uint64)
_word_hashes: dict[bytes, int] = {}


def chunks_for(percent: int) -> int:
    """Chunks with which a pair at the limit lies beyond the signature distance with a chance of about 1e-4 at most."""
    return 12 if percent >= 85 else 24


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(words: list[bytes]) -> np.ndarray:
    cache = _word_hashes
    try:
        return np.array([cache[w] for w in words], np.uint64)
    except KeyError:
        new = {w for w in words if w not in cache}
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = set(words)
        for w in new:
            cache[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.array([cache[w] for w in words], np.uint64)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; with fewer words, the whole sequence is one."""
    words = [w for w in text.translate(_ONE_SPACE).split(b" ") if w]
    if not words:
        return np.empty(0, np.uint64)
    h, n = _hashes(words), min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(out)])
    return np.unique(out + np.uint64(n))


def signature(shingles: np.ndarray, symbols: int) -> bytes:
    least = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
    multiply, add = _MULTIPLY[:symbols, None], _ADD[:symbols, None]
    for i in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[None, i : i + 4096] * multiply + add).min(1), out=least)
    return (_mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def bit_map(shingles: np.ndarray) -> bytes:
    """A bit for every value that the first ten bits of some shingle hash have."""
    bits = np.zeros(MAP_BITS, bool)
    bits[(shingles >> np.uint64(54)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _features(size: int, symbols: int):
    schema = pa.schema([("doc", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                n, keys, sigs = [], [], []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    s = shingle_set(text, size)
                    n.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(signature(s, symbols) + bit_map(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return run


def _keys(chunks: int):
    """Chunk keys, and the signature followed by the bit map as longs."""
    symbols = chunks * WIDTH
    schema = pa.schema([("set_key", pa.binary()), ("doc", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("sig", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
    shifts = (np.arange(WIDTH, dtype=np.uint64) * np.uint64(8))[None, None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(rows, symbols + 8 * MAP_WORDS)
            parts = sig[:, :symbols].reshape(rows, chunks, WIDTH).astype(np.uint64)
            whole = (parts << shifts).sum(2, dtype=np.uint64)
            keys = np.empty((rows, chunks, WIDTH), np.uint64)
            for k in range(WIDTH):
                without = whole - (parts[:, :, k] << np.uint64(8 * k))
                keys[:, :, k] = _mix((without + np.uint64(1)) * np.uint64(2 * symbols + 1) + (np.arange(chunks, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(k))[None, :])
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values))
                for width, values in ((symbols // 8 + MAP_WORDS, sig.copy().view(np.int64).ravel()), (symbols, keys.view(np.int64).ravel()))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], schema=schema)

    return run


def _sets(size: int):
    schema = pa.schema([("node", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [shingle_set(t, size).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], schema=schema)

    return run


def _distance(a: str, b: str, words: int) -> Column:
    """Number of unequal bytes of two signatures held as longs."""
    total = F.lit(0)
    for i in range(words):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for s in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _may_link(percent: int, chunks: int) -> Column:
    """Whether distance, sizes and bit maps allow a link of the classes a and b.

    A bit that only one set has stands for a shingle at least that the other lacks, so the maps bound the common
    shingles from above and no link is lost; for short sets they rule out most pairs that share a long passage only.
    """
    words = chunks * WIDTH // 8

    def only(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(words, words + MAP_WORDS)), F.lit(0))

    sizes = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    common = F.least(F.col("n_a") - only("sig_a", "sig_b"), F.col("n_b") - only("sig_b", "sig_a"))
    return sizes & (_distance("sig_a", "sig_b", words) <= 2 * chunks - 1) & ((100 + percent) * common >= percent * (F.col("n_a") + F.col("n_b")))


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough: the union has the elements of both less those met twice."""
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def joining_links(node: np.ndarray, comp: np.ndarray, block: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int, chunks: int) -> list[tuple[int, int]]:
    """Confirmed links (smaller, larger node) that join components, of all pairs across the place's blocks.

    Pairs within a block belong to the place that holds this block alone. Distance, sizes and bit maps rule out most
    pairs as in ``_may_link``; the rest are tested on their sets unless their components have been joined meanwhile.
    """
    symbols, maps = sig.view(np.uint8)[:, : chunks * WIDTH], sig[:, chunks * WIDTH // 8 :].view(np.uint64)
    n = np.array([len(x) for x in sets], np.int64)
    parent = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    alone = len(np.unique(block)) == 1
    out = []
    for first in range(0, len(node), 64):
        last = min(first + 64, len(node))
        meet = comp[first:last, None] != comp[None, :]
        meet &= np.arange(first, last)[:, None] < np.arange(len(node))[None, :]
        if not alone:
            meet &= block[first:last, None] != block[None, :]
        meet &= 100 * np.minimum(n[first:last, None], n[None, :]) >= percent * np.maximum(n[first:last, None], n[None, :])
        i, j = np.nonzero(meet)
        i += first
        for cut in range(0, len(i), 65_536):
            x, y = i[cut : cut + 65_536], j[cut : cut + 65_536]
            near = np.count_nonzero(symbols[x] != symbols[y], axis=1) <= 2 * chunks - 1
            x, y = x[near], y[near]
            only_x = np.bitwise_count(maps[x] & ~maps[y]).sum(1, dtype=np.int64)
            only_y = np.bitwise_count(maps[y] & ~maps[x]).sum(1, dtype=np.int64)
            may = (100 + percent) * np.minimum(n[x] - only_x, n[y] - only_y) >= percent * (n[x] + n[y])
            for p, q in zip(x[may].tolist(), y[may].tolist(), strict=True):
                a, b = root(int(comp[p])), root(int(comp[q]))
                if a != b and _linked(sets[p], sets[q], percent):
                    parent[max(a, b)] = min(a, b)
                    out.append((min(int(node[p]), int(node[q])), max(int(node[p]), int(node[q]))))
    return out


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _families(percent: int, chunks: int):
    """Reads rows sorted by place and emits the joining links of each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def place() -> Iterator[pa.RecordBatch]:
            node, comp, block, sig = (np.concatenate(x) for x in zip(*[h[:4] for h in held], strict=True))
            links = joining_links(node, comp, block, sig, [s for h in held for s in h[4]], percent, chunks)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], schema=_LINK)

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            where, node, comp, block = (batch.column(i).to_numpy() for i in range(4))
            sig = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1)
            offsets, values = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(where)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if where[a] != at and held:
                    yield from place()
                    held.clear()
                at = where[a]
                sets = [values[offsets[r] : offsets[r + 1]].copy() for r in range(a, b)]
                held.append((node[a:b], comp[a:b], block[a:b], sig[a:b].copy(), sets))
        if held:
            yield from place()

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, s), (y, t) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns[2:4])
            keep = [_linked(s[x[r] : x[r + 1]], t[y[r] : y[r + 1]], percent) for r in range(batch.num_rows)]
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], schema=_LINK)

    return run


def near_dedup(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_key.

    A-Z is lower-cased and words are ``[^\\x20\\x09-\\x0D]+``. Texts without words have no shingle and are linked with
    nothing; null text counts as empty. Documents whose sets have ``100 * common >= percent * union`` are linked;
    component_id is the smallest doc_id reachable. Rows without doc_id have no component and are kept. Rows repeating
    a doc_id are documents of their own, each with the links of its own text; ``text_key``, the xxhash64 of the text,
    tells them apart. Other columns are ignored.

    The join finds every pair within the distance; a pair at the similarity asked for lies beyond it with a chance of
    about 1e-4 (see ``chunks_for``), a more similar one with less.
    """
    spark, chunks = docs.sparkSession, chunks_for(percent)
    store = Store(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("text_key"), "text")
    features = store.put(rows.mapInArrow(_features(size, chunks * WIDTH), "doc long, text_key long, n long, set_key binary, sig binary"), "features")
    # A class per distinct set, with its smallest document; classes are numbered where they are stored.
    filled = features.where("set_key is not null and doc is not null")
    head = F.min(F.struct("doc", "text_key")).alias("head")
    classes = (
        filled.groupBy("set_key").agg(head, F.min("n").alias("n"), F.min("sig").alias("sig"))
        .select("set_key", "head.doc", "head.text_key", "n", "sig")
        .mapInArrow(_keys(chunks), "set_key binary, doc long, text_key long, n long, sig array<long>, keys array<long>")
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = store.put(classes, "classes")
    postings = classes.select("node", F.explode("keys").alias("key"))
    hubs = postings.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members")
    shared = store.put(postings.join(splittable(hubs, "key"), "key").select("key", "node", "hub"), "buckets")
    sig = classes.select("node", "n", "sig")
    # The sets of the classes that share a key with another one.
    nodes = classes.join(splittable(shared.select("node").distinct(), "node"), "node", "left_semi").select("node", "doc", "text_key")
    own = rows.join(nodes, ["doc", "text_key"]).select("node", "text").dropDuplicates(["node"])
    with batch_rows(spark, 4 * SET_ROWS):
        sets = store.put(own.mapInArrow(_sets(size), "node long, set array<long>"), "sets")

    left = sig.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = sig.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    stars = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = store.put(stars.join(left, "a").join(right, "b").where(_may_link(percent, chunks)).select("a", "b"), "stars")
    with_a, with_b = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in ("a", "b"))
    with batch_rows(spark, SET_ROWS):
        both = stars.join(with_b, "b").join(with_a, "a").select("a", "b", "set_a", "set_b")
        links = store.put(both.mapInArrow(_confirm(percent), "a long, b long"), "links")
    label = components(links, store)
    # What is left: members of one bucket in different components. Such buckets with one hub are one family.
    tagged = shared.select("key", "node", "hub").join(label, shared.node == label.node, "left").select("key", shared.node, "hub", F.coalesce("component", shared.node).alias("comp"))
    mixed = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_rows = store.put(tagged.join(splittable(mixed, "key"), "key", "left_semi").select("node", "hub", "comp").distinct(), "open")
    if not open_rows.isEmpty():
        members = open_rows.select("node", "comp", F.col("hub").alias("family")).join(sig, "node")
        fill = F.greatest(F.count("*") / BLOCK, 8 * F.sum("n") / BLOCK_BYTES)
        blocks = members.groupBy("family").agg(F.ceil(fill).cast("long").alias("blocks"))
        dealt = members.join(splittable(blocks, "family"), "family").join(sets, "node")
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.xxhash64("family", F.least("block", i), F.greatest("block", i)))
        dealt = dealt.withColumn("block", mine).select(F.explode(places).alias("place"), "node", "comp", "block", "sig", "set")
        with batch_rows(spark, SET_ROWS):
            dealt = dealt.repartition("place").sortWithinPartitions("place")
            more = store.put(dealt.mapInArrow(_families(percent, chunks), "a long, b long"), "more")
        if not more.isEmpty():
            label = components(links.unionByName(more), store)

    named = classes.join(label.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("set_key", "doc", F.coalesce("component", "node").alias("comp"))
    named = store.put(named, "named")
    least = splittable(named.groupBy("comp").agg(F.min("doc").alias("component")), "comp")
    named = named.join(least, "comp").select("set_key", "component")
    own = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return features.join(splittable(named, "set_key"), "set_key", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(own == F.col("doc"), F.lit(True)).alias("kept"), "text_key",
    )
