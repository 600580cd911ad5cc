import random
import re

import pytest

from tests.llm.common import edge_documents
from treeblock.llm import contamination as C
from treeblock.llm.kernels import Texts


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def holds(text, item):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    own = shingles(item)
    if not own:
        return False
    n = len(next(iter(own)))
    return len(own & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) >= 0.8 * len(own) - 1e-9


def sample():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(40)] + [(40, None), (41, ""), (42, "É À b c d")]
    texts = []
    for _ in range(120):
        base = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        part = (rng.choice(items)[1] or "").upper().split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            if part:
                part[rng.randrange(len(part))] = "changed"
        at = rng.randint(0, len(base))
        texts.append(", ".join(base[:at] + part + base[at:]))
    return items, [*texts, "", None, "é à B c d"]


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_equals_brute_force(spark, block):
    items, texts = sample()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = block if block > 1000 else 1500  # some blocks, not one an item
    got = {(r.doc_id, r.item_id) for r in C.contamination(docs, bench, block_bytes=small).collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i, x in items if holds(t, x)}
    kept = {r.doc_id for r in C.uncontaminated(docs, bench, block_bytes=small).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}


def test_signatures_hold_enough_values():
    index = C.Index([(1, "a b c d e f g h")], 0.8)
    for n in range(1, 300):
        assert index.signature(n) >= n - -(-8 * n // 10) + 1
    assert index.matches(Texts.of(["a b c d e f g h"])) == [(0, 0, 4, 4)]


def test_edges(spark):
    docs = edge_documents(spark)
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "runs away from it all the quick brown")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in C.contamination(docs, bench).collect() if r.item_id is not None)
    assert got == [(6, 1), (6, 1), (7, 1), (7, 1)]
    assert C.contamination(docs, bench.limit(0)).count() == 0 and C.contamination(docs.limit(0), bench).count() == 0
    assert C.uncontaminated(docs, bench).columns == docs.columns and C.uncontaminated(docs, bench.limit(0)).count() == docs.count()
