import os

import pytest
from oracle import SF, compare

from brookmill.llm import queries as llm
from brookmill.session import table

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, llm.queries()[name], llm.oracle_sql()[name])


def rows(spark, name):
    return [r.asDict() for r in llm.queries()[name](spark, SF).collect()]


def column(spark, name, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in table(spark, SF, name).select(*cols).collect()]


def test_splits(spark):
    got = rows(spark, "p1_split")
    assert sorted(r["row_no"] for r in got) == sorted(column(spark, "manifest", "row_no"))
    split = {r["row_no"]: r["split"] for r in got}
    assert all(r["split"] == split[r["group_row_no"]] for r in got) and set(split.values()) <= set(column(spark, "split_targets", "split"))
    assert all(split[r["row_no_a"]] == split[r["row_no_b"]] for r in rows(spark, "p1_found"))
    assert sum(r["n_rows"] for r in rows(spark, "p1_shares")) == len(got)


def test_containers(spark):
    budgets = {b: (c, m) for b, c, m in column(spark, "pack_budgets", "budget", "capacity", "max_items")}
    got = rows(spark, "p4_pack")
    keys = set(got[0])
    assert {"row_no", "budget"} <= keys and {(r["budget"], r["row_no"]) for r in got} == {(b, k) for b in budgets for k in column(spark, "manifest", "row_no")}
    assert len(rows(spark, "p4_report")) == len(budgets)


def test_leaks(spark):
    pairs = [(r["item_id"], r["doc_id"]) for r in rows(spark, "p7_found")]
    per = {r["item_id"]: r["n_documents"] for r in rows(spark, "p7_report")}
    assert pairs and len(set(pairs)) == len(pairs) and sum(per.values()) == len(pairs) and {i for i, _ in pairs} == set(per)


def test_mix(spark):
    most = {s: r for s, r in column(spark, "mix_targets", "source", "max_repeats")}
    source = dict(column(spark, "documents", "doc_id", "source"))
    got = rows(spark, "p8_mix")
    assert len({r["doc_id"] for r in got}) == len(got) and all(0 < r["copies"] <= most[r["source"]] and source[r["doc_id"]] == r["source"] and r["n_tokens"] > 0 for r in got)
    shares = rows(spark, "p8_shares")
    assert {r["source"] for r in shares} == set(most) and abs(sum(r["share"] for r in shares) - 1) < 1e-9


def test_sentences(spark):
    text = dict(column(spark, "documents", "doc_id", "text"))
    by_doc = {}
    for r in rows(spark, "p9_sentences"):
        by_doc.setdefault(r["doc_id"], []).append((r["position"], r["start_pos"], r["end_pos"], r["sentence"]))
    assert set(by_doc) == {k for k, t in text.items() if t and t.strip()}
    for k, found in by_doc.items():
        found.sort()
        assert [f[0] for f in found] == list(range(len(found))) and all(a[2] <= b[1] for a, b in zip(found, found[1:]))
        assert all(a < b and text[k][a:b] == s for _, a, b, s in found)
        assert not "".join([text[k][a:b] for a, b in zip([0] + [f[2] for f in found], [f[1] for f in found] + [len(text[k])])]).strip(" \n\t\r>　\xa0​")
    assert sum(map(len, by_doc.values())) == len(rows(spark, "p9_found"))
