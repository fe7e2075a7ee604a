"""Random histories of three joined tables: after every round each view is its query, and its feed leads to it."""

import random
from collections import Counter

import pytest

from deltaloom.streaming import engine
from deltaloom.streaming.engine import Engine

VIEWS = {
    "single": "SELECT id, x, k FROM a WHERE x <> 2",
    "groups": "SELECT k, count(*) AS n, sum(x) AS s, count(x) AS c FROM a GROUP BY k",
    "joined": "SELECT a.id, b.id AS bid, c.id AS cid, a.x + b.x AS v FROM a JOIN b ON b.id = a.k JOIN c ON c.k = b.k WHERE a.x <> 3",
    "totals": "SELECT c.k, count(*) AS n, sum(a.x * b.x) AS s FROM a, b, c WHERE b.id = a.k AND c.k = b.k GROUP BY c.k",
}


@pytest.mark.parametrize("seed, alone, bucket_bytes", [(1, 100_000, 64 << 20), (2, 0, 1 << 10)])
def test_views_follow_their_queries(spark, tmp_path, monkeypatch, seed, alone, bucket_bytes):
    monkeypatch.setattr(engine, "ALONE", alone)  # 0: feeds and running sums in parts
    r = random.Random(seed)
    e, rows = Engine(spark, str(tmp_path / "root"), bucket_bytes=bucket_bytes), {t: {} for t in "abc"}
    some = lambda i: {"id": i, "k": r.choice([0, 1, 2, 3, None]), "x": r.choice([0, 1, 2, 3, None])}
    for t in "abc":
        rows[t] = {i: some(i) for i in r.sample(range(5), 3)}
        e.register_table(t, spark.createDataFrame([(x["id"], x["k"], x["x"]) for x in rows[t].values()], "id int, k int, x int"), ["id"])
    for v, sql in VIEWS.items():
        e.create_view(v, sql)
    e.run_pending()
    schemas = {f"public.{t}": e.table_schema(t) for t in "abc"}
    held = {v: Counter(map(tuple, e.read(v).collect())) for v in VIEWS}
    cursor = dict.fromkeys(VIEWS, 0)
    for _ in range(2):
        transactions = []
        for _ in range(8):
            changes = []
            for _ in range(r.randint(1, 4)):
                t, i = r.choice("abc"), r.randrange(5)
                old = rows[t].get(i)
                new = None if old and r.random() < 0.3 else some(i)
                if old or new:
                    changes.append((f"public.{t}", "U" if old and new else "D" if old else "I", old, new))
                    rows[t].pop(i, None)
                    if new:
                        rows[t][i] = new
            transactions.append(changes or [("public.a", "U", x := some(9), x)])
        e.log.commit(transactions, schemas)
        e.drain()
        session = spark.newSession()
        for t in "abc":
            session.createDataFrame([(x["id"], x["k"], x["x"]) for x in rows[t].values()], "id int, k int, x int").createOrReplaceTempView(t)
        for v, sql in VIEWS.items():
            want = Counter(map(tuple, session.sql(sql).collect()))
            assert Counter(map(tuple, e.read(v).collect())) == want, v
            changes = e.changes(v, cursor[v], 1, 10**6).collect()
            assert [c["seq"] for c in changes] == list(range(cursor[v] + 1, cursor[v] + 1 + len(changes)))
            for c in changes:
                held[v][tuple(c["row"])] += 1 if c["op"] == "I" else -1
                assert min(held[v].values(), default=0) >= 0
            cursor[v] += len(changes)
            assert +held[v] == want, v
