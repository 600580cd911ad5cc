import math
import random
import re

import pytest

from tests.llm.common import edge_documents
from treeblock.llm import licenses as L
from treeblock.llm.kernels import Texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
TEXTS = [
    "",
    None,
    "CC BY",
    "cc-by; All Rights\nReserved. all rights reserved",
    "by general public license general public license",
    "gnu lesser general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Permission is hereby given, free of charge, to any person obtaining a copy of this software",
    "rights reserved all",
    "É cc by é",
    "cc",
    "all rights",
]


def brute(text):
    w, places, labels = WORD.findall((text or "").translate(LOW)), [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force():
    for frequency in (1, 5):
        index = L.Index({w: frequency + i % 3 for i, w in enumerate(L.vocabulary())})
        r = index.scan(Texts.of(TEXTS))
        for i, t in enumerate(TEXTS):
            assert (r["n_words"][i], r["n_base"][i], r["first_word"][i], r["last_word"][i], r["base_labels"][i]) == brute(t), t


def test_templates():
    r = L.Index(dict.fromkeys(L.vocabulary(), 1)).scan(Texts.of(TEXTS))
    assert r["labels"][5] == "gpl,lgpl" and r["labels"][6] == "mit" and r["labels"][7] == ""
    assert 1 > r["score"][6] > r["score"][7] > 0 and r["score"][0] == 0 and r["score"][5] == 1


@pytest.mark.parametrize("seed", range(3))
def test_notices_equal_brute_force(seed):
    """Notices with words changed, dropped and put in: every clause of which AGREE of the words stand in place is found."""
    rng = random.Random(seed)
    index = L.Index({w: rng.randrange(1, 50) for w in L.vocabulary()})
    texts = ["words before " + text + " and after" for _, text, _ in L.NOTICES]
    for _, text, _ in L.NOTICES * 3:
        words = text.split()
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = [rng.choice(["x", "y"])] * rng.randrange(2)
        texts.append(" ".join(words))
    r = index.scan(Texts.of(texts))
    for i, text in enumerate(texts):
        own, labels, score = WORD.findall(text.translate(LOW)), set(), 0.0
        for t in index.templates:
            keys = all(any(own[p : p + len(k)] == [w.decode() for w in k] for p in range(len(own))) for k in t.keys)
            part = 0
            for c in t.clauses:
                need = len(c) if t.base else math.ceil(L.AGREE * len(c) - 1e-9)
                hits = max(sum(0 <= p + j < len(own) and own[p + j] == w.decode() for j, w in enumerate(c)) for p in range(-len(c), len(own)))
                part += hits if hits >= need else 0
            if part and (keys or t.base):
                labels.add(t.label)
            score = max(score, part / t.size * (1 if keys else 0.5))
        assert r["labels"][i] == ",".join(sorted(labels)) and abs(r["score"][i] - score) < 1e-12
    assert all(x == 1 for x in r["score"][: len(L.NOTICES)])


def test_frequencies_and_edges(spark):
    docs = edge_documents(spark)
    docs = docs.unionByName(docs.limit(1).selectExpr("99 as doc_id", "'all of this: all rights reserved' as text", "lang", "source", "n_chars", "n_words", "score", "rule"))
    found = L.document_frequency(docs)
    assert found[b"reserved"] == 1 and found[b"all"] == 3 and found[b"gnu"] == 0
    out = L.scan_licenses(docs).collect()
    assert len(out) == docs.count() and [r.base_labels for r in out if r.doc_id == 99] == ["reserved"]
    assert L.scan_licenses(docs.limit(0)).count() == 0
