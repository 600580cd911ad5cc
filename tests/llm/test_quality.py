import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.common import edge_documents
from treeblock.llm import quality
from treeblock.llm.kernels import Texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    w = WORD.findall(text or "")
    lines = Counter(x for x in (text or "").split("\n") if WORD.search(x))
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice, marked = Counter(windows), set()
    for i, x in enumerate(windows):
        if twice[x] > 1:
            marked.update(range(i, i + 8))
    longest = 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            if k >= 8:
                longest = max(longest, k)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(v - 1 for v in lines.values()), len(marked), longest


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]


def texts():
    rng = random.Random(3)
    out = ["", "\n\n", "a", "a b\na b\n\n \na b", "é ü x y # | <b>", " ".join("abcdefghij") + " " + " ".join("abcdefghij"), "x " * 100]
    for _ in range(40):
        part = [rng.choice("abcd") for _ in range(rng.randint(5, 60))]
        out.append(" ".join(part + [rng.choice("abcdefgh") for _ in range(10)] + part[: rng.randint(0, 60)] * rng.randint(1, 3)))
    return out


def test_counts_equal_brute_force():
    source = texts()
    found = quality.measure(Texts.of(source), 0.3, 200, 20, 30)
    for i, t in enumerate(source):
        assert tuple(int(found[n][i]) for n in NAMES) == brute(t), t


def test_spans_cover_what_windows_cover():
    found = quality.measure(Texts.of(texts()), 0.3, 200, 20, 30)
    assert (found["n_covered_words"] == found["n_repeat_words"]).all()


def test_short_repeats_count_towards_coverage():
    rng = random.Random(5)
    source = texts() + [" ".join(f"{w} " * 5 for w in "abcdefgh"), " ".join(f"buy it now n{i}" for i in range(30)), " ".join(f"w{i}" for i in range(60)) + " a b c x a b c"]
    source += [" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n)) for n in (20, 60, 300)]
    found = quality.measure(Texts.of(source), 0.3, 200, 20, 30)
    for t, n in zip(source, found["n_short_covered"], strict=True):
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = Counter(windows)
        assert n == len({j for i, x in enumerate(windows) if twice[x] > 1 for j in range(i, i + 3)}), t
    # words in fives and a phrase of three, with no repeated window of eight
    assert found["base_failed"][47:50].tolist() == [False] * 3 and found["n_covered_words"][47:50].tolist() == [0] * 3
    assert found["kept"][47:50].tolist() == [False, False, True]


def test_extensions_are_the_longest_shared():
    rng = random.Random(11)
    source = [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 70))) for _ in range(30)] + ["a b", "b a", "a a a"]
    found = quality.Repeats(quality.Words(Texts.of(source), quality.WORDS))
    shared = dict(zip(found.at.tolist(), found.shared().tolist(), strict=True))
    first = 0
    for t in source:
        w = t.split()
        for i in range(len(w)):
            best = 0
            for j in range(len(w)):
                k = 0
                while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
            assert shared.get(first + i, 0) == best
        first += len(w)


def test_verdict():
    once = " ".join(f"w{i}" for i in range(100))
    long = " ".join(f"v{i}" for i in range(250))
    rows = quality.measure(Texts.of([once, "w " * 19, once + " " + once, " ".join(f"u{i}" for i in range(4000)) + long + " x " + long]), 0.3, 200, 20, 30)
    assert rows["base_failed"].tolist() == [False, True, True, False]
    assert rows["kept"].tolist() == [True, False, False, False]


def test_edge_rows(spark):
    docs = edge_documents(spark)
    out = quality.quality_rules(docs).collect()
    assert len(out) == docs.count()
    assert all(r.base_failed and not r.kept for r in out if r.n_words < 20)
    assert quality.quality_rules(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 1000])
def test_chunks_do_not_matter(spark, size, monkeypatch):
    docs = edge_documents(spark)
    want = sorted(map(repr, quality.quality_rules(docs).collect()))
    assert sorted(map(repr, quality.quality_rules(docs.repartition(3)).collect())) == want


def test_lines_are_told_apart_by_bytes(spark, monkeypatch):
    line = "a"
    while len(line) < 2048:
        line += line.translate({97: "b", 98: "a"})
    other = line.translate({97: "b", 98: "a"})
    docs = spark.createDataFrame([(1, f"{line}\n{other}"), (2, f"{line}\n{line}\n{other}\n{line}")], "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality.quality_rules(docs).collect()} == {1: 0, 2: 2}
    # and where all hashes are equal
    monkeypatch.setattr(quality, "span_codes", lambda buf, s, e: np.zeros(len(s), np.uint64))
    out = quality.measure(Texts.of(["a b\nc\na b\n\nc\nd", "c\nc"]), 0.3, 200, 20, 30)
    assert out["n_dup_lines"].tolist() == [2, 1]
