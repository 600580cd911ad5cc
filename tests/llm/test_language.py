import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.common import edge_documents
from treeblock.llm import language as L
from treeblock.llm.common import table


def test_characters():
    code, off = L.characters(["Ab1 c", None, "12", "x", "É  é", ""])
    assert ["".join(map(chr, code[off[i] : off[i + 1]])) for i in range(6)] == [" ab c ", " ", " ", " x ", " é é ", " "]


def test_probabilities_sum_to_one():
    model = L.Model({"a": ["abca abcb bcab " * 3, "cab abc"], "b": ["xyx yxy zxy " * 3]})
    letters = sorted(set("abcxyz "))
    for history in ("ab", "zz", " a", "xyz", "cab"):
        for lang in range(2):
            total = 0.0
            for c in letters:
                code = np.array([ord(x) for x in history + c], np.uint64)
                total += math.exp(model._log(min(L.ORDER, len(code)), code, np.array([len(code) - 1]))[0, lang])
            assert abs(total - 1) < 1e-3


def test_equals_plain_kneser_ney():
    texts = ["the cat sat on the mat", "then the hat sat"]
    model = L.Model({"a": texts})
    grams = defaultdict(Counter)
    code, off = L.characters(texts)
    docs = ["".join(map(chr, code[off[i] : off[i + 1]])) for i in range(len(texts))]
    raw = {n: Counter(d[i : i + n] for d in docs for i in range(len(d) - n + 1)) for n in range(1, L.ORDER + 1)}
    # of the longest order, counts; below, numbers of different longer grams that end so, one at least
    count = {L.ORDER: raw[L.ORDER]}
    for n in range(L.ORDER - 1, 0, -1):
        ends = Counter(g[1:] for g in raw[n + 1])
        count[n] = Counter({g: max(1, ends[g]) for g in raw[n]})
    for n, c in count.items():
        for g, k in c.items():
            grams[n, g[:-1]][g[-1]] = k
    discount = {}
    for n, c in count.items():
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = min(0.95, max(0.1, one / max(1, one + 2 * two)))

    def p(history, x):
        n = len(history) + 1
        below = p(history[1:], x) if history else 1 / model.alphabet
        own = grams.get((n, history))
        if not own:
            return below
        total = sum(own.values())
        return max(own[x] - discount[n], 0) / total + discount[n] * len(own) / total * below

    for text in ("the cat", "a that zz"):
        code, off = L.characters([text])
        s = "".join(map(chr, code))
        want = -sum(math.log(p(s[max(0, i - L.ORDER + 1) : i], s[i])) for i in range(1, len(s))) / (len(s) - 1)
        assert model.entropies([text])[0][0, 0] == pytest.approx(want, abs=1e-4)


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    out = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out) and np.mean([r.rejected for r in out]) < 0.01


def test_rejection_and_bounds(spark, sf):
    docs = table(spark, sf, "documents")
    model = L.fit(docs.where(~L.held_out()), max_chars=50_000)
    r = model.predict(["zzqx kkwv qqq xxyz wwkk zzvx " * 20, "the and of to is", None, "123 !", "日本語の文章です" * 30])
    assert r["rejected"].tolist() == [True, False, True, True, True] and r["lang_pred"][2:4] == ["und", "und"]
    none = L.fit(docs.limit(0))
    assert none.langs == [] and none.predict(["x", None])["lang_pred"] == ["und", "und"]


def test_unlearned_languages_are_rejected(spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents").where("lang is not null and text is not null")
    train = docs.where(~L.held_out())
    held = docs.where(L.held_out()).collect()
    for lang in sorted({r.lang for r in held}):
        model = L.fit(train.where(docs["lang"] != lang))
        own = model.predict([r.text for r in held if r.lang == lang])["rejected"]
        rest = model.predict([r.text for r in held if r.lang != lang])["rejected"]
        assert np.mean(own) > 0.85 and np.mean(rest) < 0.03, lang


def test_edges(spark):
    docs = edge_documents(spark)
    out = L.identify(docs).collect()
    assert len(out) == docs.count()
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {1, 2, 3, 4}
    assert L.identify(docs.limit(0)).count() == 0 and L.accepted(docs.limit(0)).count() == 0
    bare = L.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in bare} == {"und"} and all(r.rejected and r.score == 0 for r in bare)


def test_accepted_keeps_columns_of_any_name(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("*", "7.0d as score", "'mine' as lang_pred", "doc_id as rejected")
    gone = {r.doc_id for r in L.identify(docs).where("rejected").collect()}
    out = L.accepted(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id not in gone)
