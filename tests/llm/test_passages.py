import hashlib
import random

import numpy as np
import pytest

from tests.llm.common import edge_documents
from treeblock.llm import passages as P
from treeblock.llm.kernels import BYTE_CODES, prefix_hashes

NONE = 1 << 63


def brute(rows):
    first = {}
    key = lambda d: NONE - 1 if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], NONE), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abé ") for _ in range(rng.choice([0, 10, 49, 50, 51, 120, 600])))) for i in range(60)]
    rows += [(100 + i, rng.choice(rows)[1][rng.randrange(20) :] + "zq" * rng.randrange(60) + rng.choice(rows)[1]) for i in range(60)]
    return rows + [(5, "x" * 300), (5, "x" * 200), (500, "x" * 120), (500, None), (None, "x" * 70 + rows[5][1]), (501, "ab" * 100), (502, "ab" * 77 + "q"), rows[70], rows[70]]


SMALL = P.Bounds(flush=300, rows=20, part=30, hot=2)


@pytest.mark.parametrize("bounds", [P.Bounds(), SMALL, P.Bounds(flush=1 << 20, rows=7, part=1000, hot=5)])
def test_equals_brute_force(spark, bounds):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, P.deduplicated(docs, digest=True, bounds=bounds).collect()), key=repr) == brute(rows)


def test_rows_follow_runs_and_not_partitions(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(40)]
    rows = [(i, rng.choice(base)[: rng.randrange(100, 400)] + rng.choice(base)) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "cast(0 as int) as tag", "text").repartition(2)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, P.marks(docs, P.Bounds()).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate({97: "b", 98: "a"})
    return out[:n]


def test_equal_hashes_are_not_taken_for_equal_bytes(spark, monkeypatch):
    """Strings that collide modulo 2**64, and claims that are wrong because all runs of an anchor have one hash."""
    t = thue_morse(4096)
    rows = [(1, t), (2, t.translate({97: "b", 98: "a"})), (3, "x" + t[:2048])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, P.deduplicated(docs, digest=True).collect())) == brute(rows)
    raw = b"abcdefghij" * 20
    claim = raw[:60] + b"?" + raw[61:110] + b"!" + raw[111:]
    assert P.verified(raw, 0, 200, claim) == [(0, 60), (111, 200)] and P.verified(raw, 10, 100, raw[10:100]) == [(10, 100)]
    assert P.verified(raw, 100, 200, raw[100:140]) == [] and P.cut("aé".encode() * 2, [(2, 4, None)], True) == ("aé".encode(), [(1, 4)])


def test_suffix_order_sorts():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    buf[1000:1300] = buf[200:500]
    at = np.arange(2900)
    prefix = prefix_hashes(BYTE_CODES[buf])
    from treeblock.llm.kernels import span_hash

    group = span_hash(prefix, at, at + 12)
    order, new = P.suffix_order(P.Suffixes(buf, prefix, at), group)
    assert sorted(order.tolist()) == at.tolist()
    text = [buf[i : i + 50].tobytes() for i in order]
    assert all(new[i + 1] or text[i] <= text[i + 1] for i in range(len(text) - 1))
    x, y = at[:-300], at[300:]
    want = [next((k for k in range(50) if buf[a + k] != buf[b + k]), 50) for a, b in zip(x, y, strict=True)]
    assert P.extension(prefix, x, y).tolist() == want


def test_texts_and_other_columns(spark):
    docs = edge_documents(spark)
    out = P.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    copy = docs.where("doc_id = 5").selectExpr("50 as doc_id", "concat('new start é ', text) as text", "lang", "source", "length(text) + 12 as n_chars", "n_words", "score", "rule")
    row = P.deduplicated(docs.unionByName(copy)).where("doc_id = 50").first()
    assert row.text.startswith("new start") and len(row.text) < 60 and row.n_chars == len(row.text)
    assert P.deduplicated(docs.limit(0)).count() == 0 and P.deduplicated(docs.limit(0), True).count() == 0
