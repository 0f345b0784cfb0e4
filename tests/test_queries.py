"""Every registered query against its DuckDB statement, on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from tallow import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def answers(spark, request):
    """A future of (types, rows) for each query that this run tests; planning of small queries takes most of the time, so they overlap."""

    def answer(name):
        got = plans.QUERIES[name](spark, DATA)
        return got.dtypes, got.collect()

    chosen = [i.callspec.params["name"] for i in request.session.items if i.path == request.path]
    pool = ThreadPoolExecutor(6)
    yield {name: pool.submit(answer, name) for name in chosen}
    pool.shutdown(cancel_futures=True)


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(answers, duck, name):
    dtypes, got = answers[name].result()
    columns = sorted(c for c, _ in dtypes)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got)
    if name not in plans.ORACLES:
        assert rows
        return
    answer = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    kinds = {d[0]: str(d[1]) for d in answer.description}
    assert {c: TYPES[k] for c, k in dtypes if k in TYPES} == {c: kinds[c] for c, k in dtypes if k in TYPES}
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert rows == want
