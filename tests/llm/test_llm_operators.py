"""Operators against brute force, exact round trips and odd inputs."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parcelpay.llm import byte_bpe, chat, exact_dedup, language, licenses, near_dedup, neighbours, packing, quality, token_files
from parcelpay.llm.common import Store
from parcelpay.llm.components import components
from parcelpay.llm.queries import ship

WORDS = "the of and river stone light over under cloud field wind small green house song water bird winter road hand".split()


@pytest.fixture(autouse=True)
def package(spark):
    ship(spark)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(40, 120))) for _ in range(25)]
    out = list(base)
    for t in base[:12]:
        for _ in range(4):
            w = t.split()
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = "changed" + str(r.randrange(99))
            out.append(" ".join(w))
    out += [None, "", " \n\t", "one", "ONE", "two words", base[0], base[0].replace(" ", "\n"), base[0].upper(), "x" * 50_000]
    return list(enumerate(out))


@pytest.fixture
def docs(spark, texts):
    rows = [(i, t, "keep", True, None) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, kept boolean, score double")


def normal(t):
    return re.sub("[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("bound, digest", [(1 << 20, exact_dedup.sha256), (300, exact_dedup.sha256), (400, lambda b: b"same" * 8)])
def test_exact_dedup(spark, docs, texts, bound, digest):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, table_bytes=bound, digest=digest).collect()}
    groups = {}
    for i, t in texts:
        groups.setdefault(normal(t), []).append((-len(t or ""), i))
    assert len(got) == len(texts)
    for i, t in texts:
        members = groups[normal(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(members)[1], len(members), min(members)[1] == i)
        if digest is exact_dedup.sha256:
            assert got[i]["text_sha256"] == hashlib.sha256(normal(t).encode()).hexdigest()


def test_exact_dedup_odd_rows(spark):
    rows = [(None, "a"), (3, "a"), (3, "a"), (1, " a"), (None, None)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["kept"] for r in got) == 2 and len(got) == 5 and {r["keep_id"] for r in got if r["group_size"] == 4} == {1}
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_files(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    extra = [(1000, "Straße ÉTÉ it's 12,5 <|endoftext|> \x85 x́ Σας İx naïve… 中文\x1cok"), (1001, "don't WE'LL <|x _y_ 'Stop")]
    more = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    path, name = str(tmp_path / "orc"), public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(more, path, name, end_id=2)
    files = token_files.read_token_files(spark, path)
    got = {r["doc_id"]: r for r in token_files.token_digest(files).collect()}
    whole, start = Tokenizer.from_file(name), 0
    for i, t in [*texts, *extra]:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), i
        start += len(ids)
    plan = files.where("doc_id = 5")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(doc_id,5\)", plan)


def test_chat(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", "more")
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [(None, None)], 7: [a, c]}
    rows = [(k, n, r, t, "x") for k, v in convs.items() for n, (r, t) in enumerate(v)] + [(3, 0, *a, "x"), (None, 0, *a, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies string")
    for block in (512, 1):
        out = chat.format_chats(df, block).collect()
        assert {(r["conv_id"], r["n_turns"], r["copies"]) for r in out} == {(3, 3, 2), (5, 1, 1), (6, 1, 1), (7, 2, 1)}
        whole = "".join(r["text"] for r in sorted(out, key=lambda r: r["part"]) if r["conv_id"] == 3)
        assert whole == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello <\\|im_end|><|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_licenses(spark):
    r = random.Random(3)
    plain = [" ".join(r.choice(WORDS) for _ in range(12)) for _ in range(60)]
    named = {100: ("MIT", "Released under the MIT License."), 101: ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), 102: ("Apache-2.0", "licensed under the apache license, version 2.0")}
    rows = [(i, t) for i, t in enumerate(plain)] + [(i, f"{plain[0]}\n{t}\n") for i, (_, t) in named.items()] + [(200, None), (201, ""), (None, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan_licenses(df, licenses.train_licenses(df)).collect()
    assert {(x["doc_id"], x["paragraph"], x["family"], x["confirmed"]) for x in got} == {(i, 1, f, True) for i, (f, _) in named.items()} | {(None, 0, "MIT", True)}


def test_licenses_wrapped(spark):
    import textwrap

    r = random.Random(6)
    plain = [" ".join(r.choice(WORDS) for _ in range(12)) for _ in range(60)]
    notices = {(i, f): textwrap.fill(licenses.TEMPLATES[f][-1], 68 if i < 110 else 40, initial_indent=" * ", subsequent_indent=" * ") for i, f in ((100, "MIT"), (101, "GPL-3.0"), (102, "BSD"), (110, "MIT"), (111, "GPL-3.0"), (112, "BSD"))}
    rows = list(enumerate(plain)) + [(i, f"{plain[0]}\n{plain[1]}\n\n{t}\n\n{plain[2]}\n") for (i, _), t in notices.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan_licenses(df, licenses.train_licenses(df)).collect()
    assert {(x["doc_id"], x["paragraph"], x["family"]) for x in got if x["confirmed"]} >= {(i, 3, f) for i, f in notices}
    assert all(x["family"] == f for x in got if x["confirmed"] for i, f in notices if i == x["doc_id"])


def test_license_words_are_never_passed_over(spark):
    words = ["license", "licensed", "2.0", "gpl", "redistribution"]
    r = random.Random(1)
    parts = [*words, " ", ".", "-", "a", "Redistribution", "é", "1", "x."]
    df = spark.createDataFrame([("".join(r.choices(parts, k=6)),) for _ in range(2000)], "t string")
    found = df.select(licenses._may_hold(F.col("t"), words).alias("may"), F.arrays_overlap(licenses.words_of(F.col("t")), licenses._constant(words)).alias("has"))
    got = {(x["may"], x["has"]) for x in found.distinct().collect()}
    assert (False, True) not in got and len(got) == 3


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_dedup(docs, texts, size, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs, size=size, percent=percent).collect()}
    assert got == brute_components(texts, size, percent)


def test_near_dedup_blocks_of_open_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    r = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(r.choice((2, 4, 8, 12, 16)))])) for i in range(80)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()}
    expected = brute_components(rows, 3, 85)
    assert got == expected and len({c for _, c in expected.values()}) > 3


def test_near_dedup_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (1, "A  b\nc"), (1, "A b c")], "doc_id long, text string")
    got = near_dedup.near_dedup(df).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter({(None, None, True): 1, (2, 1, False): 1, (1, 1, True): 2})
    assert near_dedup.near_dedup(df.limit(0)).count() == 0


def test_near_dedup_repeated_id_with_different_texts(spark):
    """Before, only the links of one of the texts were found, of which one depended on the order of rows."""
    r = random.Random(21)
    a, b = ([f"w{r.randrange(10**6)}" for _ in range(200)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (4, " ".join(a[:100])), (4, " ".join(["z", *b]))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = sorted((x["doc_id"], x["component_id"], x["n_shingles"]) for x in near_dedup.near_dedup(df).collect())
        assert got == [(1, 1, 196), (1, 1, 196), (2, 1, 197), (3, 1, 197), (4, 1, 197), (4, 4, 96)]


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 260)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long"), Store(spark)).collect()}
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {v: c for v, c in label.items() if v != c}


def test_language(spark):
    r = random.Random(1)
    voc = {"xx": ["kala", "suna", "mori", "tako"], "yy": ["brent", "stolk", "grund", "plimt"], "zz": ["слово", "земля", "вода"]}
    rows = [(i, " ".join(r.choice(voc[x]) for _ in range(30)), x) for i in range(60) for x in voc]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_language(df)
    odd = [(1, None), (2, "12 !!"), (3, "kala suna mori " * 3 + "brent stolk " * 9), (4, "земля вода"), (5, "")]
    got = {x["doc_id"]: x for x in language.identify(spark.createDataFrame(odd, "doc_id long, text string"), model, keys=["doc_id"], spans=True).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["und", "und", "yy", "zz", "und"]
    assert [tuple(s) for s in got[3]["spans"]] == [(0, 9, "xx"), (9, 27, "yy")]
    empty = language.train_language(df.limit(0))
    assert {x["lang_pred"] for x in language.identify(df.limit(3), empty, keys=["doc_id"]).collect()} == {"und"}


def test_language_letters_and_rare_languages(spark):
    rows = [(i, f"kala suna mori{i} tako", "xx") for i in range(2000)] + [(i, f"brent stolk grund plimt{i}", "yy") for i in range(5000, 5040)]
    rows += [(9000, "same text of a third", "xx")] * 1000
    df = spark.createDataFrame([(i, re.sub(r"\d", lambda m: chr(97 + int(m[0])), t), x) for i, t, x in rows], "doc_id long, text string, lang string")
    model = language.train_language(df, max_rows=200)
    assert model.langs == ["xx", "yy"]
    odd = [(1, "½ ² ①"), (2, "½ brent stolk"), (3, "kala " * 60_000)]
    odd = spark.createDataFrame(odd + odd[:1], "doc_id long, text string")
    got = Counter((x["doc_id"], x["lang_pred"], x["score"]) for x in language.identify(odd, model, keys=["doc_id"]).collect())
    assert got == Counter({(1, "und", 0.0): 2, (2, "yy", 1.0): 1, (3, "xx", 1.0): 1})
    assert language.identify(odd.limit(0), model, keys=["doc_id"]).count() == 0


def test_single_state_is_the_best_path():
    r = np.random.Generator(np.random.PCG64(2))
    kept = 0
    for _ in range(300):
        s = r.normal(size=(int(r.integers(1, 12)), 3)) * 2 + np.array([1.5, 0, 0])
        path, state = language.viterbi([s], 2.0)[0], language.single_state(s, 2.0)
        if state >= 0:
            assert (path == state).all()
            kept += 1
        else:
            assert s[np.arange(len(s)), path].sum() - 2.0 * np.count_nonzero(np.diff(path)) >= s.sum(0).max() - 1e-9
    assert 50 < kept < 300
    many = r.normal(size=(40, 200)) * 9
    assert language.viterbi([many])[0].max() > 127


def test_viterbi_is_best_path():
    import itertools

    r = np.random.Generator(np.random.PCG64(1))
    scores = [r.normal(size=(n, 3)) * 3 for n in (1, 4, 6)]
    for s, path in zip(scores, language.viterbi(scores, 2.0), strict=True):
        def value(p):
            return sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
        assert value(path) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=len(s))))


def test_byte_bpe(spark, docs, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(1000, "a  b \n\n c\t d e it's  "), (1001, "naïve 中文字 🙂🙂 \x00 <|endoftext|>"), (1002, " "), (1003, "\n \n x")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    ids = byte_bpe.encode_texts(more, path, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in byte_bpe.decode_ids(ids, path, public_tokenizers.PATTERN).collect()}
    for i, t in [*texts, *extra]:
        assert got[i]["ids"] == whole.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()
    table = byte_bpe.PerfectHash({b"k%d" % i: i for i in range(500)})
    assert [table.get(b"k%d" % i) for i in range(500)] == list(range(500)) and table.get(b"other") == -1


def test_packing(docs, texts):
    rows = packing.best_fit_packing(docs, sizes=(16, 32, 64)).collect()
    used, tokens = {}, Counter()
    for r in sorted(rows, key=lambda r: (r["shard"], r["bin"], r["bin_offset"], r["length"])):
        key = (r["shard"], r["bin"])
        assert r["bin_offset"] == used.get(key, 0) and r["length"] <= 64
        used[key] = r["bin_offset"] + r["length"]
        tokens[r["doc_id"]] += r["length"]
    sizes = {(r["shard"], r["bin"]): r["bin_size"] for r in rows}
    assert all(sizes[k] == min(s for s in (16, 32, 64) if s >= n) for k, n in used.items())
    assert tokens == Counter({i: len((t or "").split()) for i, t in texts}) and len(tokens) == len(texts)
    assert packing.pack([10, 6, 5, 11], (16, 32))[2] in ([32], [16, 16]) and packing.best_fit_packing(docs.limit(0)).count() == 0


def test_packing_counts_token_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from parcelpay.llm.queries import QUERIES

    texts = [(1, "don't unbelievably overlengthened words"), (2, "没有空格的中文文本" * 900), (3, "x" * 50_000), (4, None), (5, ""), (6, "ไม่มีช่องว่าง")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts}
    for out in (QUERIES["op8_packing"](spark, str(tmp_path)), corpus_pipeline.best_fit(spark, df, str(tmp_path))):
        rows, tokens, held = out.collect(), Counter(), Counter()
        for r in rows:
            tokens[r["doc_id"]] += r["length"]
            held[r["shard"], r["bin"]] += r["length"]
        assert tokens == expected and max(expected.values()) > 4096
        assert all(held[r["shard"], r["bin"]] <= r["bin_size"] and r["length"] <= 4096 for r in rows)


def test_packing_shards_by_pieces_and_copies(spark):
    long = spark.createDataFrame([(1, 64 * 1000)], "doc_id long, n long")
    rows = packing.best_fit_packing(long, sizes=(16, 64), shard_pieces=100, length_col="n").collect()
    assert sorted(r["piece"] for r in rows) == list(range(1000)) and max(Counter(r["shard"] for r in rows).values()) < 200
    copies = spark.createDataFrame([(None, 0)] * 5000 + [(i, 3) for i in range(100)], "doc_id long, n long")
    rows = packing.best_fit_packing(copies, sizes=(16, 64), shard_pieces=1000, length_col="n").collect()
    assert Counter(r["length"] for r in rows) == {0: 5000, 3: 100}
    assert len({r["shard"] for r in rows if r["length"] == 0}) > 3 and sum(r["doc_id"] is None for r in rows) == 5000


def test_neighbours(spark):
    r = np.random.Generator(np.random.PCG64(3))
    x = r.normal(size=(400, 8)).astype(np.float32)
    x[100:160] = x[40]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>")
    got = {}
    for row in neighbours.nearest(df, lambda c: F.col(c) % 20 == 0, k=20).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = row
    assert sorted(got) == list(range(0, 400, 20))
    d, hit = x.astype(float), 0
    for q, ranks in got.items():
        s = d @ d[q]
        best = [i for i in sorted(range(400), key=lambda i: (-s[i], i)) if i != q][:20]
        found = [ranks[k]["vec_id"] for k in range(1, 21)]
        assert [ranks[k]["score"] for k in range(1, 21)] == pytest.approx([s[i] for i in found]) and q not in found
        hit += len(set(best) & set(found))
    assert hit >= 0.9 * 400
    few = neighbours.nearest(df.where("vec_id < 5"), lambda c: F.col(c) % 20 == 0).collect()
    assert len(few) == 4 and neighbours.nearest(df.limit(0), lambda c: F.col(c) == 0).count() == 0


def test_neighbours_of_mixed_lengths(spark):
    """Before, one longer vector made all others vanish."""
    r = np.random.Generator(np.random.PCG64(7))
    x = r.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, [1.0] * 9), (7, x[7].tolist()), (120, [0.5] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("id", F.lit(0))
    got = neighbours.nearest(df, lambda c: F.col(c) % 20 == 0, k=5).collect()
    assert Counter(g["query_id"] for g in got) == Counter({0: 5, 20: 5, 40: 5, 100: 1, 120: 1})
    for g in got:
        if g["query_id"] < 100:
            best = sorted((i for i in range(60) if i != g["query_id"]), key=lambda i: -(x[i] @ x[g["query_id"]]))
            assert g["vec_id"] == best[g["rank"] - 1]


def test_neighbours_recall_and_candidates():
    """Recall and share of candidates of the setting, by the hash functions on the given vectors."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("tables not present")
    table = pq.read_table(path)
    ids, lists = table.column("vec_id").to_numpy(), table.column("embedding").combine_chunks()
    x = np.array(lists.to_pylist(), float)
    scale = float(np.sqrt((x * x).sum(1).max())) * (1 + 1e-9)
    args = (x.shape[1], scale, neighbours.TABLES, neighbours.HASHES, neighbours.WIDTH, neighbours.PROBES, 9)

    def buckets(rows, query):
        batch = pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(x[rows].tolist(), pa.list_(pa.float64()))], names=["id", "v"])
        return [set(b) for out in neighbours._hash(*args, query)([batch]) for b in out.column(1).to_pylist()]

    asked = np.flatnonzero(ids % 20 == 0)
    held = buckets(np.arange(len(x)), False)
    hit = share = 0.0
    for q, visited in zip(asked, buckets(asked, True), strict=True):
        s = x @ x[q]
        s[q] = -np.inf
        near = np.argsort(-s)[:20]
        met = np.array([not visited.isdisjoint(b) for b in held])
        hit += met[near].mean() / len(asked)
        share += met.mean() / len(asked)
    assert hit >= 0.9 and share <= 0.7


def test_neighbours_pair_found_by_many_tasks(spark):
    """Before, a pair scored in blocks of different shapes took several ranks of its query."""
    r = np.random.Generator(np.random.PCG64(4))
    x = r.normal(size=(1500, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        got = neighbours.nearest(rows, lambda c: F.col(c) % 20 == 0, k=20, tables=8, block=37).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert Counter(g["query_id"] for g in got) == Counter({q: 20 for q in range(0, 1500, 20)})
    assert len({(g["query_id"], g["vec_id"]) for g in got}) == len(got)


def test_neighbours_scores_do_not_depend_on_the_block():
    r = np.random.Generator(np.random.PCG64(5))
    x = r.normal(size=(3000, 64))
    whole = neighbours._scores(x, x[0])
    for n in (1, 2, 7, 37, 512, 2000):
        assert np.array_equal(neighbours._scores(x[-n:], x[0]), whole[-n:])


def test_quality(spark):
    r = random.Random(4)
    good = [" ".join(r.choice(WORDS) for _ in range(40)) + "." for _ in range(80)]
    bad = [" ".join(r.choice(WORDS).upper() + "!!" for _ in range(40)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(120) if i % 3], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.score_quality(df, quality.train_quality(df, labels), keys=["doc_id"]).collect()}
    assert all(got[i]["predicted"] == int(i < 80) for i in range(0, 120, 3))
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got.values()) and len(got) == 122
    none = quality.score_quality(df, quality.train_quality(df, labels.limit(0)), keys=["doc_id"]).collect()
    assert {x["score"] for x in none} == {0.5}


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, names = spark.read.parquet(f"{d}/documents.parquet"), []
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = Store(spark).put(stage(spark, docs, d), name)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            counts.append(out.count())
            rest = [tuple(r) for r in out.select("doc_id", "text").collect()]
            if name == "quality_filter":
                before = rest
            if name == "exact_dedup":
                assert len(rest) == len({normal(t) for _, t in before})
                exact = rest
            if name == "near_dedup":
                heads = brute_components(exact, 5, 80)
                assert {i for i, _ in rest} == {i for i, (_, c) in heads.items() if c == i}
        else:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {i for i, _ in rest}
        docs = out
        names.append(name)
    assert counts == sorted(counts, reverse=True) and len(names) == 5


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(WORDS[:12])
    rows = [(1, text, "a", "b"), (1, text + " more", "a", "b"), (2, text, "a", None), (None, text + "  ", "a", "b"), (3, None, "a", "b"), (None, "", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _own string").withColumn("_sha", F.lit(0)).withColumn("_key", F.lit(1))
    spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.quality_filter(spark, docs, str(tmp_path)).count() == 6  # one kind of label ranks nothing
    exact = corpus_pipeline.exact_duplicates(spark, docs, str(tmp_path))
    assert exact.columns == docs.columns
    assert Counter((r["doc_id"], (r["text"] or "").strip()) for r in exact.collect()) == Counter([(None, text), (1, text + " more"), (3, "")])
    near = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in near.collect()) == Counter([(1, text), (1, text + " more"), (None, text + "  "), (3, None), (None, "")])


def test_token_files_of_many_files(spark, tmp_path):
    from tokenizers import Tokenizer

    name, path = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "orc")
    docs = spark.range(0, 300).selectExpr("id AS doc_id", "concat('word', id, ' of stone') AS text")
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        token_files.write_token_files(docs.unionByName(docs.where("doc_id = 5")).unionByName(spark.createDataFrame([(None, None)], "doc_id long, text string")), path, name, end_id=2)
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    got = sorted(tuple(r) for r in token_files.file_digest(spark, path).select("start", "doc_id", "n_tokens").collect())
    whole, start = Tokenizer.from_file(name), 0
    expected = [None, *range(6), 5, *range(6, 300)]
    for (at, doc, n), i in zip(got, expected, strict=True):
        ids = whole.encode("" if i is None else f"word{i} of stone", add_special_tokens=False).ids
        assert (at, doc, n) == (start, i, len(ids) + 1)
        start += n
    token_files.write_token_files(docs.limit(0), path + "0", name, end_id=2)
    assert token_files.file_digest(spark, path + "0").count() == 0


def test_round_trip(spark, docs, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = byte_bpe.ByteBpe(path, public_tokenizers.PATTERN, cache_bytes=5000)  # a cache that is emptied often
    rows = docs.unionByName(docs.where("doc_id = 3"))
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(rows, path, public_tokenizers.PATTERN).collect()}
    for i, t in texts:
        ids = np.array(codec.encode(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_word_cache_smaller_than_one_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, whole = token_files.WordEncoder(path, cache_words=5), Tokenizer.from_file(path)
    for text in ("one two", "three one four", " ".join(WORDS), "two one", "", " "):
        assert encoder.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
