"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from jobs import queries as jobs
from lodestone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


QUERIES, ORACLES = {**registry.QUERIES, **jobs.QUERIES}, {**registry.ORACLES, **jobs.ORACLES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name not in ORACLES:
        assert rows
        return
    kinds = {r[0]: r[1] for r in con.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in rows)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert got == sorted(map(repr, want))


def test_texts_are_read_where_they_lie(spark, sf, monkeypatch):
    """Only texts of what was found leave the documents: the ids found are sent to them, and nothing is sorted or dealt out by text."""
    plans, write = [], registry.scratch.kept
    monkeypatch.setattr(registry.scratch, "kept", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    assert registry.QUERIES["f14_context"](spark, sf).count() > 0
    lines = plans[0].splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "text:string" in x)
    above = next(x for x in reversed(lines[:scan]) if "Join" in x or "Exchange" in x)
    assert "BroadcastHashJoin" in above and "LeftSemi" in above, plans[0]
