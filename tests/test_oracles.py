"""Every query with SQL against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from strandline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return v if isinstance(v, float) else str(v)


def close(a, b):
    """Equal, or floats that differ by the order in which they were added up: two roundings of a tie at the fifth decimal at most, and below 1e-3 (p-values, rates) at the sixth."""
    if not (isinstance(a, float) and isinstance(b, float)):
        return a == b
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1.01e-5 if max(abs(a), abs(b)) > 1e-3 else 1.01e-6)


def rank(row):
    return [repr(v) for v in row if not isinstance(v, float)], [round(v, 3) for v in row if isinstance(v, float)]


def compare(spark, duck, sf_dir, query, sql):
    got = query(spark, sf_dir)
    cols = sorted(got.columns)
    duck.execute(sql)
    names = [d[0] for d in duck.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in duck.fetchall()), key=rank)
    found = sorted((tuple(norm(v) for v in r) for r in got.select(*cols).collect()), key=rank)
    assert len(found) == len(want)
    off = [(a, b) for a, b in zip(found, want) if not all(map(close, a, b))]
    # Rows whose rounded floats tie may sit in another order; they must still find a partner each.
    left = [b for _, b in off]
    for a, _ in off:
        partner = next((b for b in left if all(map(close, a, b))), None)
        assert partner is not None, (a, left[:3])
        left.remove(partner)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, sf_dir, name):
    compare(spark, duck, sf_dir, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["track_assign", "normality_check", "shape_modes", "bootstrap_ci", "pluggable_bootstrap", "shape_components"])
def test_rows_only(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_stream_equals_batch_for_tracks(spark, sf_dir):
    key = lambda df: sorted(map(tuple, df.select("recording_id", "frame", "label", "track_id").collect()))
    assert key(catalog.QUERIES["stream_tracker"](spark, sf_dir)) == key(catalog.QUERIES["track_assign"](spark, sf_dir))


def test_stream_equals_batch_for_gap_sessions(spark, sf_dir):
    key = lambda df: sorted(map(tuple, df.select("recording_id", "label", "first_frame", "last_frame", "n").collect()))
    assert key(catalog.QUERIES["stream_gap_sessions"](spark, sf_dir)) == key(catalog.QUERIES["gap_sessions"](spark, sf_dir))


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
