import re

import pytest

import corpus_pipeline
from tests.oracle import check, connect
from treeblock.llm import language, mixing, queries
from treeblock.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, sf, name):
    check(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


def test_all_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {m[0] for q in found if (m := re.match(r"op\d+_", q))} and "pipeline" in found


def test_pipeline_equals_its_parts_by_brute_force(spark, sf):
    from tests.llm.test_contamination import holds
    from tests.llm.test_neardup import brute

    docs = table(spark, sf, "documents")
    rejected = {r.doc_id for r in language.identify(docs).where("rejected").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected]
    heads = {min(c) for c in brute(rows)}
    rows = sorted(r for r in rows if r[0] in heads)
    first, cut = {}, []
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        cut.append((d, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    want = {d: t for d, t in cut if not any(holds(t, x) for x in items)}
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == docs.columns + mixing.COLUMNS
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near duplicates", "suffix-array dedup", "benchmark decontamination", "mixing"]
