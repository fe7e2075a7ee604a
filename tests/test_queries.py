"""Queries on small tables, with bounds lowered that only large tables reach, against their SQL."""

from collections import Counter

import duckdb
import pytest

from deltaloom import queries
from deltaloom.operators import delta
from deltaloom.streaming import engine

DATA = "/root/testdata/sf0.001"


def wanted(name):
    db = duckdb.connect()
    for n in ("orders", "customer", "nation"):
        db.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    return Counter(db.execute(queries.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["feed_join2", "feed_numbered", "feed_proj", "feed_replay"])
def test_feeds_longer_than_engines_keep(spark, monkeypatch, name):
    monkeypatch.setitem(engine.SETTINGS, "retain_deltas", (50, *engine.SETTINGS["retain_deltas"][1:]))
    monkeypatch.setattr(engine, "ALONE", 50)
    want = wanted(name)
    assert sum(want.values()) > 50
    assert Counter(map(tuple, queries.queries()[name](spark, DATA).collect())) == want


def test_groups_without_a_key_at_every_size(spark, monkeypatch):
    """Running sums go in the same stretches whatever the number of changes, and rows are right on both sides of a new base."""
    seen, fold = [], delta.fold_groups
    monkeypatch.setattr(delta, "fold_groups", lambda *x: seen.append(x[-1]) or fold(*x))
    for alone, most in ((100_000, 5_000_000), (0, 5_000_000), (100_000, 100)):
        monkeypatch.setattr(engine, "ALONE", alone)
        monkeypatch.setitem(engine.SETTINGS, "compact_changes", (most, *engine.SETTINGS["compact_changes"][1:]))
        assert Counter(map(tuple, queries.keyless_agg(spark, DATA).collect())) == wanted("keyless_agg")
    assert seen == [8, 8, 8]
