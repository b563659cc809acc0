"""The queries of the package on the smallest tables, and against their oracle where one is written."""

import os

import duckdb
import pytest

pytest.importorskip("kollate.llm.queries")
from kollate.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": ["row_id", "field"], "p2_found": ["canonical_id", "group_id"], "p3_found": ["canonical_id", "trove_work_id"], "p4_found": ["canonical_id", "field", "row_id"], "p5_found": ["row_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id_a", "doc_id_b"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len({str(r) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    df = queries.QUERIES[name](spark, SMALL)
    found = con.execute(queries.ORACLES[name])
    assert [d[0] for d in found.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())
