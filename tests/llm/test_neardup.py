import random
import re
from collections import Counter

import numpy as np

from tests.llm.common import edge_documents
from treeblock.llm import neardup as N
from treeblock.llm.kernels import mix


def multiset(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows):
    bags, parent = [multiset(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            shared = sum((a & b).values())
            alike = shared / max(1, sum(a.values()) + sum(b.values()) - shared) >= 0.8 - 1e-9 if a and b else not a and not b and rows[i][1] and rows[i][1] == rows[j][1]
            if alike:
                parent[root(i)] = root(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(root(i), set()).add(d)
    return {frozenset(v) for v in out.values()}


def sample():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    # a chain: each like the next, the ends unlike each other; and words that repeat
    chain = [rng.choice(words) for _ in range(200)]
    for k in range(8):
        for i in range(4):
            chain[k * 20 + i] = f"c{k}{i}"
        rows.append((len(rows), " ".join(chain)))
    rows += [(len(rows) + i, "echo " * n) for i, n in enumerate((50, 55, 100))]
    return rows + [(9000, ""), (9001, None), (9002, "!!"), (9003, "!!"), (9004, "?!")]


def test_classes_equal_brute_force(spark):
    rows = sample()
    out = N.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {}
    for r in out:
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(v) for v in got.values()} == brute(rows)
    assert all(min(v) == k for k, v in got.items())
    assert sum(r.kept for r in out) == len(got) and all(r.class_size == len(got[r.class_id]) for r in out)
    kept = N.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(got)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    x = mix(np.arange(1, 400, dtype=np.uint64))
    a = rng.integers(0, 6, len(x))
    b = np.where(rng.random(len(x)) < 0.7, a, rng.integers(0, 9, len(x)))
    want, found = np.minimum(a, b).sum() / np.maximum(a, b).sum(), []
    for k in range(40):
        y = mix(x + np.uint64(k * 7919))
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = N.bag_min_hash(doc, np.concatenate([y[a > 0], y[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 96)
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - want) < 0.03


def test_overlaps_count_multiplicity():
    a, b = "a b c d e " * 4, "a b c d e " * 8
    bags = multiset(a), multiset(b)
    want = sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())
    assert abs(N.overlaps([a.encode(), b"x y"], [b.encode(), b"x y"])[0] - want) < 1e-12


def test_components_of_a_long_path(spark):
    n = 40
    links = spark.createDataFrame([(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(n)] + [(b"x", b"y")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.label) for r in N.components(links).collect()}
    assert len(got) == n + 3 and {v for k, v in got.items() if k[:1] == b"0"} == {b"000"} and got[b"y"] == b"x"


def test_edges(spark):
    docs = edge_documents(spark)
    out = {}
    for r in N.classes(docs).collect():
        out.setdefault(r.doc_id, []).append((r.class_id, r.kept))
    assert out[7] == [(6, False)] and out[6] == [(6, True)]
    assert out[8] == [(8, True)] * 2 and out[1] == [(1, True)] and out[2] == [(2, True)] and out[None] == [(None, True)]
    kept = N.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 8").count() == 1 and kept.where("doc_id = 7").count() == 0
    assert N.classes(docs.limit(0)).count() == 0 and N.distinct_documents(docs.limit(0)).count() == 0


def test_columns_of_any_name_and_great_ids(spark):
    rows = [((1 << 63) - 1, "one two three four five six"), (None, "one two three four five six"), (None, "alone in the world as it is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' as node", "1 as __id", "2 as id", "3 as row", "4 as label")
    out = {(r.doc_id, r.class_id, r.kept) for r in N.classes(docs).collect()}
    assert out == {((1 << 63) - 1, (1 << 63) - 1, True), (None, (1 << 63) - 1, False), (None, None, True)}
    kept = N.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(*rows[0], "n", 1, 2, 3, 4), (*rows[2], "n", 1, 2, 3, 4)], key=repr)


def test_unlike_texts_that_collide_modulo_powers_of_two(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: "b", 98: "a"})
    one, two = " ".join(word), " ".join(word.translate({97: "b", 98: "a"}))
    rows = [(1, one), (2, two), (3, word), (4, word.translate({97: "b", 98: "a"})), (5, one.upper())]
    got = {}
    for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(v) for v in got.values()} == brute(rows)
    assert N.Words(N.Texts.of([one, two, one + "."]), N.WORD_BYTES).digests()[0] == N.Words(N.Texts.of([one, two, one + "."]), N.WORD_BYTES).digests()[2] != N.Words(N.Texts.of([two]), N.WORD_BYTES).digests()[0]


def test_block_similarities_are_exact():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 60))).encode() for _ in range(30)]
    N_a, N_b = N.Bags(texts[:12]), N.Bags(texts[12:])
    got = N.similarities(N_a, N_b)
    for i, x in enumerate(texts[:12]):
        for j, y in enumerate(texts[12:]):
            a, b = multiset(x.decode()), multiset(y.decode())
            assert abs(got[i, j] - sum((a & b).values()) / sum((a | b).values())) < 1e-6


def test_families_beyond_a_block(spark, monkeypatch):
    """A family larger than a block whose hub does not link all: a ladder of texts, each like its neighbours only."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(40):
        base = list(base)
        for i in range(2):
            base[(k * 7 + i) % 120] = f"x{k}{i}"
        rows.append((k, " ".join(base)))
    rng.shuffle(rows)
    monkeypatch.setattr(N, "BLOCK", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {}
    for r in N.classes(docs).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(v) for v in got.values()} == brute(rows)
