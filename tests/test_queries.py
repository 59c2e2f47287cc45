"""Every registered query of the symbol-graph library against its oracle on the smallest tables."""

import duckdb
import pytest

from docgraph.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value.item() if hasattr(value, "item") else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    at = [columns.index(c) for c in sorted(columns)]
    want = [tuple(plain(r[i]) for i in at) for r in cursor.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
