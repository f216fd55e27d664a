"""Every registered query with SQL, against DuckDB on the same tables."""

import duckdb
import pytest

from weftline.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(v):
    return v.isoformat() if hasattr(v, "isoformat") else round(v + 0.0, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = duck.sql(registry.ORACLES[name])
    assert cols == sorted(r.columns)
    got = sorted((tuple(map(norm, x)) for x in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(map(norm, x)) for x in r.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert got == want
