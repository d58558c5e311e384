"""Every query of the subpackage on the smallest tables, against its SQL twin where there is one."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["id", "defect", "item"], "p2_found": ["id", "kind"], "p3_found": ["id"], "p4_found": ["id_a", "id_b"],
    "p5_found": ["id", "defect"], "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = [tuple(r) for r in df.collect()]
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name in registry.ORACLE:
        rel = sql.sql(registry.ORACLE[name])
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[k] for k in at)) for r in rel.fetchall())
