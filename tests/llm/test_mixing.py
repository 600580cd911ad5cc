from fractions import Fraction

import pytest

from tests.llm.common import edge_documents
from treeblock.llm import mixing as M


def test_every_row_has_a_place(spark):
    rows = [(i, f"t{i}", "en", "s0" if i % 3 == 0 else f"s{i % 4 + 1}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = M.mixed(docs, {"s0": 0.25}, block_rows=5).collect()
    assert sorted(r.doc_id for r in out) == list(range(2000))
    assert len({(r.mix_slot, r.mix_place) for r in out}) == 2000
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in out)
    order = sorted(out, key=lambda r: (r.mix_slot, r.mix_place))
    # as long as no source has run out, each has its weight but for a block
    for n in (100, 500, 900):
        assert abs(sum(r.source == "s0" for r in order[:n]) - 0.25 * n) <= 2 * 5
    by = {}
    for r in order:
        by.setdefault(r.source, []).append((r.mix_block, r.mix_place))
    assert all(v == [(i // 5, i % 5) for i in range(len(v))] for v in by.values())


def test_edges(spark):
    docs = edge_documents(spark).selectExpr("*", "'x' as mix_slot")
    out = M.mixed(docs, {"a": 0.5})
    assert out.columns == [c for c in docs.columns if c != "mix_slot"] + M.COLUMNS
    found = out.collect()
    assert len(found) == docs.count() and len({(r.mix_slot, r.mix_place) for r in found}) == len(found)
    assert M.mixed(docs.limit(0), {}).count() == 0
    assert M.exact_shares(["a", "b"], {"a": 0.0}) == ({"b": 1}, 1) and M.exact_shares(["a"], {"a": 0.0}) == ({}, 1)
    rest = M.mixed(docs.where("source = 'a'"), {"a": 0.0}).collect()
    assert len({(r.mix_slot, r.mix_place) for r in rest}) == len(rest) > 0


@pytest.mark.parametrize("n,weights", [(20, {"s0": 0.1}), (3, {"s0": 0.7, "s1": 0.2999}), (1500, {"s0": 0.1}), (4, {"s0": 0.0004})])
def test_exact_weights_over_many_periods(n, weights):
    share, period = M.exact_shares([f"s{i}" for i in range(n)], weights)
    listed = {s: Fraction(str(w)) for s, w in weights.items()}
    target = {s: listed.get(s, (1 - sum(listed.values())) / (n - len(listed))) for s in share}
    slots = M.schedule(share, period)
    turns = 100_000 // period + 1
    for s, w in list(target.items())[:25]:
        assert w * period == share[s]
        # block i of the whole schedule is the (i + 1)-th: before and after it, less than a block from the target
        for i, t in enumerate(x + k * period for k in range(turns) for x in slots[s]):
            assert abs(i - t * w) < 1 and abs(i + 1 - (t + 1) * w) < 1


def test_mixed_keeps_exact_weights(spark):
    rows = [(i, f"t{i}", f"s{i % 20:02d}") for i in range(20_000)] + [(20_000 + i, "", "none") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.mixed(docs, {"s00": 0.1, "none": 0.0}, block_rows=1).collect()
    assert len({r.mix_slot for r in out}) == len(rows) and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in out)
    assert min(r.mix_slot for r in out if r.source == "none") > max(r.mix_slot for r in out if r.source != "none")
    for r in out:
        if r.source != "none":
            w = Fraction(1, 10) if r.source == "s00" else Fraction(9, 190)
            assert r.mix_release == r.mix_block // w and abs(r.mix_block - r.mix_slot * w) < 1
    assert M.mixed(spark.range(1500).selectExpr("id as doc_id", "'' as text", "cast(id as string) as source"), {}).select("mix_slot").distinct().count() == 1500
