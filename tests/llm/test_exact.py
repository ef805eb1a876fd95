"""Exact dedup: SQL on the given tables, brute force on odd rows and many runs."""

from __future__ import annotations

from collections import defaultdict

import pytest
from conftest import SMALL
from oracle import compare, duck

from stayweave.llm import exact, queries


def test_query_matches_sql(spark):
    ok, note = compare(spark, duck(SMALL), SMALL, "op8", queries.QUERIES["op8_exact_dedup"], queries.ORACLES["op8_exact_dedup"])
    assert ok, note


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_odd_rows(odd, keep):
    got = exact.groups_of_copies(odd, keep=keep).collect()
    rows = odd.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    assert len(got) == len(rows)
    assert sorted(r.group_size for r in got) == sorted(len(g) for g in groups.values() for _ in g)
    ids = {i: [x for x in g if x is not None] for g in groups.values() for i in g}
    for r in got:
        known = ids[r["_id"]]
        assert r.keep_id == ((min if keep == "smallest" else max)(known) if known else None)
    assert sum(r["_row"] == r.keep_row for r in got) == len(groups)


def test_many_runs(spark):
    rows = spark.range(0, 3000, 1, 150).selectExpr("id as doc_id", "concat('t', pmod(id, 7)) as text")
    got = exact.groups_of_copies(rows, fan=3).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(i, 429 if i < 4 else 428) for i in range(7)}


def test_drop_copies(odd, none):
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1", "3", "4", "None", "6", "8", "9", "10"])
    assert exact.groups_of_copies(none).count() == 0 and exact.drop_copies(none).count() == 0
