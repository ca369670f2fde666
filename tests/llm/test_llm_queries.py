"""Queries with SQL against DuckDB; all others over the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reviewloom.llm import queries
from reviewloom.llm.encode import tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": "doc_id bigint, family string", "p2_found": "review_id bigint, token string", "p5_found": "product_id string, review_id bigint",
    "p6_found": "review_a bigint, review_b bigint", "p7_found": "token string, mark string", "p8_ids": "doc_id bigint, ids array<int>",
    "p9_found": "doc_id bigint", "p10_found": "doc_a bigint, doc_b bigint",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(tokenizer_path()), reason="no test tables or vocabulary")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(rows):
    return sorted(tuple("%.6f" % v if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    if name in COLUMNS:
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == COLUMNS[name]
    got = df.select(*sorted(df.columns)).collect()
    if name not in queries.SQL:
        return
    r = duck.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert norm(got) == norm([tuple(x[names.index(c)] for c in sorted(names)) for x in r.fetchall()])


@pytest.fixture(scope="module", params=["empty", "null"])
def bare(request, tmp_path_factory):
    """The tables without rows, or with nulls in all columns but ids and times."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    d = tmp_path_factory.mktemp(request.param)
    keep = {"review_id", "doc_id", "raw_id", "loaded_at", "reviewed_at", "posted_at"}
    for f in os.listdir(SF):
        t = pq.read_table(f"{SF}/{f}").slice(0, 0 if request.param == "empty" else 40)
        pq.write_table(pa.table({c: t[c] if c in keep else pa.nulls(t.num_rows, t.schema.field(c).type) for c in t.column_names}), d / f)
    return str(d)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_bare_tables(spark, bare, name):
    got = queries.QUERIES[name](spark, bare).count()
    assert got == 0 if "empty" in bare else got >= 0
