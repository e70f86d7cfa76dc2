"""Personal data, vector codes and hard negatives against brute force, and their odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelpay.llm import hard_negatives, pii, vector_codes
from parcelpay.llm.queries import ship

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(autouse=True)
def package(spark):
    ship(spark)


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def random_texts():
    r = random.Random(3)
    parts = [*"@.+- ()0123456789aZ%_é\n", "4111111111111111", "+1 (132) 555-1352", "a.b@c.d", "192.168.000.255", "1.2.3.4.5", "378282246310005", "DE89370400440532013000"]
    return ["".join(r.choices(parts, k=r.randrange(60))) for _ in range(4000)]


def test_base_spans_equal_the_plain_patterns():
    found = 0
    for t in random_texts():
        got = [f"{k}:{a}:{b}" for k, a, b, _ in pii.find_spans(t) if k in pii.BASE]
        assert got == base_spans(t), t
        found += len(got)
    assert found > 2000


def test_added_spans_need_checksum_or_words():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("DE89 3704 0044 0532 0130 00 IS") == ["iban"] and kinds("GB82WEST12345698765432") == ["iban"]
    assert kinds("DE88 3704 0044 0532 0130 00") == [] and kinds("XDE89370400440532013000") == []
    assert kinds("my tel 555-123-4567 now") == ["local_phone"] and kinds("nr 555-123-4567 now") == []
    assert kinds("ssn 123-45-6789") == ["national_id"] and kinds("ssn 000-45-6789") == [] and kinds("123-45-6789") == []
    assert kinds("order example tel 555-123-4567") == []  # a word for and one against
    scores = [pii.find_spans(t)[0][3] for t in ("card 4111111111111111", "4111111111111111", "sample 4111111111111111")]
    assert scores == [1.0, 0.8, 0.5]
    assert pii.luhn("378282246310005") and not pii.luhn("378282246310006") and pii.mod97("GB82WEST12345698765432")


@pytest.mark.parametrize("unit", ["@", "x", "0", "1.", "+1 ", "1 ", "A1", "DE89 ", "a@b.", "555-", "(555) "])
def test_long_runs_take_linear_time(unit):
    assert len(pii.find_spans(unit * 100_000)) <= 100_000


def test_pii_rows(spark):
    rows = [(1, "x a@b.co y", "s"), (1, "x a@b.co y", "s"), (None, "é +1 (132) 555-1352", "s"), (2, None, "s"), (3, "", "s"), (4, "a" * 200_000 + "@b.c", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in pii.pii_digest(pii.find_pii(docs)).collect()), key=str)
    assert len(got) == 6
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by_text = {r[6]: r for r in got}
    assert by_text["email:2:8"][:6] == (1, 1, 0, 0, 0, sha("email:2:8")) and by_text[""][5] == sha("")
    assert by_text["phone:2:19"][0] is None and "email:0:200004" in by_text
    assert pii.find_pii(docs.limit(0)).count() == 0
    shown = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert shown[1] == "x [email] y" and shown[None] == "é [phone]" and shown[2] == "" and shown[4] == "[email]"


def brute_codes(rows, parts, entries, rounds):
    """(id, x) of one length: code, error and the codebooks."""
    border = vector_codes.cuts(len(rows[0][1]), parts)
    x = np.array([np.floor(256 * np.array(v, np.float64)) for _, v in rows]).astype(np.int64)
    first = {}
    for i, v in sorted(((i, v.tolist()) for (i, _), v in zip(rows, x)), key=lambda p: (p[0] is None, p[0] or 0, p[1])):
        first.setdefault(i, v)
    start = np.array(list(first.values())[:entries])
    books = [start[:, a:b].copy() for a, b in zip(border, border[1:])]
    for step in range(rounds + 1):
        code, error = [], 0
        for p, book in enumerate(books):
            d = ((x[:, None, border[p] : border[p + 1]] - book[None]) ** 2).sum(2)
            code.append(d.argmin(1))
            error = error + d.min(1)
            if step < rounds:
                for e in range(len(book)):
                    if (code[-1] == e).any():
                        book[e] = x[code[-1] == e, border[p] : border[p + 1]].sum(0) // (code[-1] == e).sum()
    return ["".join(f"{c:02x}" for c in row) for row in zip(*code)], error, books


@pytest.mark.parametrize("size, spread", [(64, 50.0), (64, 2.0), (7, 3.0), (1, 1.0)])
def test_orchard_search_is_exact(size, spread):
    r = np.random.default_rng(size)
    entries, x = (np.round(r.normal(size=(n, 4)) * spread).astype(np.int64) for n in (size, 3000))
    index, best = vector_codes.Codebook.of(entries).nearest(x)
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_vector_codes(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=12).round(2).tolist(), int(r.integers(3))) for i in range(300)]
    rows += [(5, rows[9][1], 1), (None, rows[8][1], None), (900, [0.0] * 12, None), (901, rows[3][1], 2)]
    odd = [(902, [1.0, 2.0], 1), (903, [], 1), (904, None, 1), (905, [None] + [0.0] * 11, 1), (906, [float("nan")] * 12, 1), (907, [float("inf")] * 12, 0), (908, [1e30, -1e30], 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("other")).repartition(5)
    got = vector_codes.with_label_error(vector_codes.compress(df, parts=4, entries=16)).collect()
    code, error, books = brute_codes([(i, v) for i, v, _ in rows], 4, 16, 2)
    assert len(got) == len(rows) + 3
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b.tolist() for c in e).encode()).hexdigest()
    expected = sorted((str(i), c, int(e), sha) for (i, _, _), c, e in zip(rows, code, error))
    assert sorted((str(g.vec_id), g.code, g.error, g.codebooks_sha256) for g in got if g.vec_id is None or g.vec_id < 902) == expected
    total = {}
    for g in got:
        total[g.label] = total.get(g.label, 0) + g.error
    assert all(g.label_error == total[g.label] for g in got)
    extra = {g.vec_id: g for g in got}
    assert extra[903].error == 0 and extra[903].code == "00" * 4 and extra[902].error + extra[908].error == 0
    assert vector_codes.with_label_error(vector_codes.compress(df.limit(0))).count() == 0


def test_vector_codes_reconstruct(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=8).tolist(), 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = vector_codes.whole_vectors(df, "label")
    books = vector_codes.train_codebooks(whole, [8], parts=4, entries=64)
    back = {g.vec_id: g.vector for g in vector_codes.reconstruct(vector_codes.encode(whole, books), books).collect()}
    assert all(np.allclose(back[i], v, atol=1 / 256 + 1e-12) for i, v, _ in rows)  # every vector is an entry of its own


def brute_negatives(rows, anchors, k=5, low=80):
    x = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v, _ in rows}
    label = {i: l for i, _, l in rows}
    out = []
    for a in anchors:
        scored = sorted((-int(x[a] @ x[i]), i) for i in x if i != a and len(x[i]) == len(x[a]))
        for s, p in [(-s, i) for s, i in scored if label[i] == label[a]][:k]:
            window = [(i, -n) for n, i in scored if label[i] != label[a] and low * s <= -100 * n <= 100 * s][:k]
            out += [(a, p, rank, i, s, n) for rank, (i, n) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, place_rows", [(4096, 131072), (16, 64), (7, 7)])
def test_hard_negatives(spark, block, place_rows):
    r = np.random.default_rng(8)
    centres = r.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + r.normal(size=12) * 0.6).round(2).tolist(), int(r.integers(4))) for i in range(400)]
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x")).repartition(5)
    got = hard_negatives.mine(df, lambda i: i % 20 == 0, block=block, place_rows=place_rows)
    expected = brute_negatives(rows, [i for i, _, _ in rows if i % 20 == 0])
    assert sorted(tuple(g) for g in got.collect()) == expected and len(expected) > 100


def test_hard_negatives_odd_rows(spark):
    good = [(0, [1.0, 1.0], 0), (1, [1.0, 0.9], 0), (2, [0.9, 0.9], 1), (3, [-1.0, 0.0], 0), (4, [0.0, 0.0], 1), (5, [0.95, 0.9], 1)]
    odd = [(6, None, 1), (7, [None, 1.0], 1), (8, [float("nan"), 1.0], 1), (9, [0.9, 0.9], None), (None, [0.9, 0.9], 1), (10, [0.9, 0.9, 0.9], 1), (11, [], 1), (2, [0.9, 0.9], 1), (12, [float("inf"), 0.0], 1)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(g) for g in hard_negatives.mine(df, lambda i: i == 0).collect())
    assert got == brute_negatives(good, [0]) and {g[1] for g in got} == {1}
    assert hard_negatives.mine(df.limit(0), lambda i: i == 0).count() == 0
    far = spark.createDataFrame([(0, [1e20], 0), (1, [1e20], 0), (2, [1e19], 1)], "vec_id long, embedding array<double>, label int")
    assert [g.negative_id for g in hard_negatives.mine(far, lambda i: i == 0).collect()] == [2]
