"""Every registered query with SQL, on the smallest tables, against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from reviewloom.plans import general_queries, index_queries

SF = "/root/testdata/sf0.001"
NAMES = [*index_queries.QUERIES, *general_queries.QUERIES]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(rows):
    return sorted(tuple("%.6f" % v if isinstance(v, float) else str(v) for v in r) for r in rows)


def compare(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    r = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert norm(got) == norm([tuple(x[i] for i in at) for x in r.fetchall()])


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    compare(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


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


@pytest.mark.parametrize("name", NAMES)
def test_bare_tables(spark, bare, name):
    assert entry.queries()[name](spark, bare).count() >= 0
