"""Rounds, feeds, failures and readers, on histories small enough to check by hand."""

import pytest

from deltaloom.errors import BuildFailed, DirectWrite, EpochChanged, Exists, Lagged, NotFound, Stale, ViewError
from deltaloom.operators import delta
from deltaloom.streaming.client import Resync, Snapshot, Subscription, Transaction, lines
from deltaloom.streaming.engine import Engine, compact

STOPS, FARES, RIDES = "city.stops", "city.fares", "city.rides"
LINES = "SELECT r.ride, s.label, r.riders * f.cents AS v FROM city.rides r JOIN city.stops s ON s.stop = r.stop JOIN city.fares f ON f.fare = r.fare WHERE r.state = 'done'"
ZONES = LINES.replace("r.ride, s.label, r.riders * f.cents AS v", "s.zone, count(*) AS n, sum(r.riders * f.cents) AS s") + " GROUP BY s.zone"


def city(spark, tmp_path, **settings):
    e = Engine(spark, str(tmp_path / "root"), **settings)
    e.register_table(STOPS, spark.createDataFrame([(1, "Elm", "N"), (2, "Oak", "S"), (3, "Fir", "S")], "stop int, label string, zone string"), ["stop"])
    e.register_table(FARES, spark.createDataFrame([(1, "day", 3), (2, "night", 7), (3, "week", 11)], "fare int, label string, cents int"), ["fare"])
    e.register_table(RIDES, spark.createDataFrame([(1, 2, 1, 4, "done"), (2, 1, 2, 1, "open"), (3, 3, 3, 2, "done")], "ride long, stop int, fare int, riders int, state string"), ["ride"])
    schemas = {t: e.table_schema(t) for t in (STOPS, FARES, RIDES)}
    row = lambda t, *v: dict(zip(schemas[t].names, v, strict=True))
    return e, lambda *txs: e.log.commit(txs, schemas), row


def feed(e, view, after=0, epoch=1, rows=10**6, hidden=False):
    return [(r["op"], *r["row"]) for r in e.changes(view, after, epoch, rows, hidden).collect()]


@pytest.mark.parametrize("bucket_bytes", [64 << 20, 1 << 10])
def test_joins_see_other_tables_as_of_their_transaction(spark, tmp_path, bucket_bytes):
    e, commit, row = city(spark, tmp_path, bucket_bytes=bucket_bytes)
    e.create_view("lines", LINES)
    e.create_view("zones", ZONES)
    assert e.status("lines")["status"] == "initializing"
    e.run_pending()
    assert (e.manifest["views"]["public.lines"]["state"]["n"] > 1) == (bucket_bytes == 1 << 10)
    commit([(RIDES, "I", None, row(RIDES, 4, 1, 2, 3, "done"))], [(STOPS, "U", row(STOPS, 1, "Elm", "N"), row(STOPS, 1, "Ash", "N"))])
    e.drain()
    got = [(r["op"], r["row"]["ride"], r["row"]["label"], r["lsn"]) for r in e.changes("lines", 0, 1).collect() if r["row"]["ride"] == 4]
    assert got == [("I", 4, "Elm", 1), ("D", 4, "Elm", 2), ("I", 4, "Ash", 2)]
    assert feed(e, "zones") == [("I", "N", 1, 21)]
    assert sorted(map(tuple, e.read("lines").collect())) == [(1, "Oak", 12), (3, "Fir", 22), (4, "Ash", 21)]
    # A stop moves zone: one group after the other, before ahead of after.
    seq = e.current_seq("zones")
    commit([(STOPS, "U", row(STOPS, 2, "Oak", "S"), row(STOPS, 2, "Oak", "N"))])
    e.drain()
    assert sorted(feed(e, "zones", seq)) == [("D", "N", 1, 21), ("D", "S", 2, 34), ("I", "N", 2, 33), ("I", "S", 1, 22)]
    assert e.wait_for("zones", "0/3")
    before = e.manifest["version"]
    assert not e.run_round() and e.manifest["version"] == before  # an idle round writes nothing


def test_two_engines_on_a_folder(spark, tmp_path):
    e, commit, row = city(spark, tmp_path)
    other = Engine(spark, e.root)
    e.create_view("a", "SELECT ride, riders FROM city.rides")
    other.create_view("b", "SELECT ride, stop FROM city.rides")
    assert sorted(e.manifest["views"]) == ["public.a"] and {e.status("a")["status"], e.status("b")["status"]} == {"initializing"}
    other.run_pending()
    commit([(RIDES, "I", None, row(RIDES, 8, 1, 1, 1, "open"))])
    # The other engine commits while this one is in a round: this round is undone, and the next finds nothing to do.
    inner, calls = e._move_shadows, []

    def meanwhile():
        calls.append(other.run_round())
        inner()

    e._move_shadows = meanwhile
    assert e.run_round() and calls == [True]
    e._move_shadows = inner
    assert not e.run_round() and e.frontier("a") == 1 and e.current_seq("a") == 1
    assert sorted(r["ride"] for r in e.read("b").collect()) == [1, 2, 3, 8]


def test_snapshots_stay_readable(spark, tmp_path):
    e, commit, row = city(spark, tmp_path)
    e.create_view("v", "SELECT ride, riders FROM city.rides")
    e.run_pending()
    frames = [e.read("v"), e.storage("v")]
    for i in range(10):
        commit([(RIDES, "I", None, row(RIDES, 100 + i, 1, 1, i, "open"))])
        e.drain()
    assert [f.count() for f in frames] == [3, 3] and e.read("v").count() == 13
    # Past their time, what was replaced is removed, as is what the log no longer needs.
    e.settings["keep_seconds"] = 0
    for i in range(10, 13):
        commit([(RIDES, "I", None, row(RIDES, 100 + i, 1, 1, i, "open"))])
        e.drain()
    assert len(e.manifest["trash"]) < 8 and e.read("v").count() == 16


def test_a_round_writes_what_it_touches(spark, tmp_path):
    """Bytes of state and shadows that a round of ten transactions writes, for tables of 2,000 and of 20,000 rows."""
    wrote = []
    for n in (2_000, 20_000):
        e = Engine(spark, str(tmp_path / str(n)), bucket_bytes=1 << 10)
        e.register_table("big", spark.range(n).selectExpr("id", "id % 97 AS part", "cast(id as string) AS x"), ["id"])
        e.register_table("parts", spark.range(97).selectExpr("id AS part", "concat('p', id) AS name"), ["part"])
        e.create_view("v", "SELECT b.id, p.name, b.x FROM big b JOIN parts p ON p.part = b.part")
        e.run_pending()
        layouts = e.manifest["shadows"]["public.big"]["layouts"]
        assert [x["by"] for x in layouts] == [["id"], ["part"]] and layouts[0]["n"] > 8
        row = lambda i, x: {"id": i, "part": i % 97, "x": x}
        e.log.commit([[("public.big", "U", row(i, str(i)), row(i, f"new{i}"))] for i in range(10)], {"public.big": e.table_schema("big")})
        size = lambda kind, e=e: e._bytes(f"{e.root}/{kind}")
        before = size("view"), size("shadow")
        e.drain()
        assert e.read("v").where("x like 'new%'").count() == 10 and e.read("v").count() == n
        wrote.append((size("view") - before[0], size("shadow") - before[1], before))
    (small_view, _, _), (view, shadow, whole) = wrote
    assert view < 3 * small_view and view < whole[0] / 3 and shadow < whole[1] / 2


def test_settings_and_the_logs_rules(spark, tmp_path):
    for bad in ({"poll_interval_ms": 0}, {"retain_deltas": 0}, {"nope": 1}):
        with pytest.raises(ValueError):
            Engine(spark, str(tmp_path / "x"), **bad)
    e, commit, row = city(spark, tmp_path)
    commit([(RIDES, "D", row(RIDES, 1, 2, 1, 4, "done"), None)])
    changes = e.log.read(RIDES, e.table_schema(RIDES), 0, 9)
    with pytest.raises(ValueError, match="not after"):  # the rest of a transaction that the log has
        e.log.append({RIDES: changes.selectExpr("lsn", "xid", "ord + 1 AS ord", "op", "before", "after")})
    with pytest.raises(ValueError, match="two transactions"):
        e.log.append({RIDES: changes.selectExpr("5L AS lsn", "explode(array(1L, 2L)) AS xid", "ord", "op", "before", "after")})
    with pytest.raises(ValueError, match="no position"):
        e.log.append({RIDES: changes.selectExpr("5L AS lsn", "xid", "ord", "'X' AS op", "before", "after")})
    assert e.log.end() == 1 and len(e.log.segments()) == 1


def test_the_log_is_trimmed(spark, tmp_path):
    e, commit, row = city(spark, tmp_path, keep_seconds=0, compact_changes=3)
    e.create_view("lines", LINES)
    e.run_pending()
    for i in range(12):
        commit([(RIDES, "I", None, row(RIDES, 50 + i, 1, 1, 1, "done"))])
        e.drain()
    assert len(e.log.segments()) < 8 and e.log.end() == 12
    e.refresh("lines")
    e.run_pending()
    assert e.read("lines").count() == 14


def test_netting_and_null_sums(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"))
    e.register_table("s", spark.createDataFrame([(1, 1, None, None)], "id long, k int, v int, w int"), ["id"])
    e.create_view("agg", "SELECT k, count(*) AS n, sum(v) AS v, count(w) AS c, sum(w) AS w FROM s GROUP BY k")
    e.create_view("hid", "SELECT k, sum(v) AS v FROM s GROUP BY k")
    e.run_pending()
    schemas = {"public.s": e.table_schema("s")}
    r = lambda *v: dict(zip(("id", "k", "v", "w"), v, strict=True))
    commit = lambda *txs: e.log.commit([[("public.s", *c) for c in t] for t in txs], schemas)
    assert [tuple(x) for x in e.read("agg").collect()] == [(1, 1, None, 0, None)]
    commit(
        [("U", r(1, 1, None, None), r(1, 1, 3, None))],  # a first value
        [("I", None, r(2, 2, 5, 5)), ("D", r(2, 2, 5, 5), None)],  # came and went
        [("U", r(1, 1, 3, None), r(1, 1, 9, None)), ("U", r(1, 1, 9, None), r(1, 1, 3, None))],  # there and back
        [("U", r(1, 1, 3, None), r(1, 1, None, None))],  # the last value goes
        [("I", None, r(3, 1, 0, None))],
        [("I", None, r(4, 1, None, None))],  # hidden counters only, for hid
        [("I", None, r(5, None, 1, 1))],  # a null key is a group
        [("D", r(5, None, 1, 1), None)],  # and goes when empty
    )
    e.drain()
    assert feed(e, "hid") == [("D", 1, None), ("I", 1, 3), ("D", 1, 3), ("I", 1, None), ("D", 1, None), ("I", 1, 0), ("I", None, 1), ("D", None, 1)]
    assert [tuple(x) for x in e.storage("hid").collect()] == [(1, 0, 1, 3)]
    assert e.frontier("hid") == 8
    assert [x[0] for x in e.changes("hid", 0, 1).select("seq").collect()] == list(range(1, 9))


def test_paging_keeps_transactions_whole(spark, tmp_path):
    e, commit, row = city(spark, tmp_path, retain_deltas=40)
    e.create_view("v", "SELECT ride, riders FROM city.rides WHERE state = 'done'")
    e.run_pending()
    one = lambda i: (RIDES, "I", None, row(RIDES, i, 1, 1, 1, "done"))
    commit([one(10)], [one(11)], [one(i) for i in range(20, 50)])
    e.drain()
    count = lambda after, n: len(e.changes("v", after, 1, n).collect())
    assert (count(0, 1), count(0, 2), count(2, 10), count(0, 10), count(0, 0)) == (1, 2, 30, 32, 1)
    assert count(99, 5) == 0  # a cursor beyond the end is accepted
    with pytest.raises(EpochChanged) as x:
        e.changes("v", 0, 7)
    assert x.value.detail == "epoch 7 -> 1"
    commit([one(i) for i in range(60, 80)])
    e.drain()
    with pytest.raises(Lagged) as x:
        e.changes("v", 0, 1)
    assert x.value.code == "IV001" and x.value.detail == "oldest retained seq is 13"


def test_one_view_fails_alone(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"))
    e.register_table("t", spark.createDataFrame([(1, 4)], "id long, k int"), ["id"])
    e.create_view("good", "SELECT id, k FROM t")
    e.create_view("bad", "SELECT id, 60 % (k - 3) AS q FROM t")
    e.run_pending()
    schemas = {"public.t": e.table_schema("t")}
    e.log.commit([[("public.t", "I", None, {"id": i, "k": 3 if i == 7 else i + 10})] for i in range(2, 13)], schemas)
    states = []
    for _ in range(3):
        e.run_round()
        states.append((e.status("bad")["status"], e.frontier("bad"), e.manifest["views"]["public.bad"]["failures"]))
    assert states == [("live", 5, 1), ("live", 5, 2), ("stale", 5, 3)]
    assert e.frontier("good") == 11 and e.read("good").count() == 12 and e.read("bad").count() == 6
    with pytest.raises(Stale, match="IV002") as x:
        e.changes("bad", 0, 1)
    assert x.value.detail.startswith("apply failed 3 times")
    # A refresh that fails keeps the old rows; one that works starts an epoch.
    e.refresh("bad")
    e.run_pending()
    assert e.status("bad")["status"] == "failed" and e.read("bad").count() == 6
    with pytest.raises(BuildFailed):
        e.await_ready("bad")
    e.log.commit([[("public.t", "D", {"id": 7, "k": 3}, None)]], schemas)
    e.refresh("bad")
    assert e.await_ready("bad") and e.status("bad")["epoch"] == 2 and e.read("bad").count() == 11


def test_truncate_drift_and_drop(spark, tmp_path):
    e, commit, row = city(spark, tmp_path)
    e.create_view("p", "SELECT fare, cents FROM city.fares")
    e.create_view("n", "SELECT fare, label FROM city.fares")
    e.create_view("o", "SELECT ride, riders FROM city.rides")
    e.run_pending()
    assert e.alter_table(FARES, spark.createDataFrame([(1, "day", 2.5)], "fare int, label string, cents double")) == ["public.p"]
    assert e.status("p")["stale_reason"] == "column cents of city.fares was dropped, renamed or changed type"
    assert e.status("n")["status"] == "live"
    e.refresh("p")
    assert e.await_ready("p") and e.read("p").collect()[0]["cents"] == 2.5
    commit([(RIDES, "T", None, None)], [(RIDES, "I", None, row(RIDES, 50, 1, 1, 1, "done"))])
    e.drain()
    assert e.status("o")["status"] == "stale" and "truncated" in e.status("o")["stale_reason"]
    e.refresh("o")
    assert e.await_ready("o") and [tuple(r) for r in e.read("o").collect()] == [(50, 1)]
    with pytest.raises(ViewError, match="depend"):
        e.unregister_table(RIDES)
    e.unregister_table(RIDES, cascade=True)
    with pytest.raises(NotFound):
        e.status("o")


def test_key_changes_unchanged_values_and_shadow_moves(spark, tmp_path):
    e, commit, row = city(spark, tmp_path)
    e.create_view("lines", LINES)
    e.run_pending()
    sent = row(RIDES, 3, None, 3, 5, "done")
    e.log.commit([[(RIDES, "U", row(RIDES, 1, 2, 1, 4, "done"), row(RIDES, 9, 2, 1, 4, "done"))], [(RIDES, "U", row(RIDES, 3, 3, 3, 2, "done"), sent, ["stop"])]], {RIDES: e.table_schema(RIDES)})
    e.drain()
    assert sorted(map(tuple, e.read("lines").collect())) == [(3, "Fir", 55), (9, "Oak", 12)]
    assert e.manifest["shadows"][RIDES]["frontier"] == 2
    compact(e, RIDES)
    # A second engine on the same folder goes on where the first was.
    again = Engine(spark, e.root)
    again.create_view("zones", ZONES)
    again.run_pending()
    assert sorted(map(tuple, again.read("zones").collect())) == [("S", 2, 67)]
    assert sorted(again.closure("lines")) == ["public.lines", "public.zones"]
    again.drop_view("lines")
    again.drop_view("zones")
    assert again.manifest["shadows"] == {}


def test_subscription_and_guards(spark, tmp_path):
    e, commit, row = city(spark, tmp_path)
    e.create_view("v", "SELECT ride, riders FROM city.rides WHERE state = 'done'")
    with pytest.raises(Exists):
        e.create_view("V", "SELECT ride, riders FROM city.rides")
    with pytest.raises(DirectWrite):
        e.insert_into("v")
    s = Subscription(e, "v", batch=2)
    assert list(s.poll()) == []  # still being built
    e.run_pending()
    first = list(s.poll())
    assert [type(x) for x in first] == [Snapshot] and first[0].rows.count() == 2
    commit([(RIDES, "I", None, row(RIDES, i, 1, 1, 1, "done")) for i in (10, 11, 12)], [(RIDES, "D", row(RIDES, 10, 1, 1, 1, "done"), None)])
    e.drain()
    got = list(s.poll())
    assert [(type(x), x.lsn, len(x.deltas)) for x in got] == [(Transaction, 1, 3), (Transaction, 2, 1)] and s.cursor == 4
    assert lines(got[1])[0] == "tx lsn=0/2 xid=1002 deltas=1"
    assert first[0].rows.count() == 2  # an old snapshot stays as it was
    e.refresh("v")
    e.run_pending()
    assert [x.reason for x in s.poll() if isinstance(x, Resync)] == ["epoch changed"]
    assert isinstance(next(s.poll()), Snapshot)
    s.close()


def test_streaming_query_maintains(spark, tmp_path):
    from deltaloom.streaming.stream import maintain

    e, commit, row = city(spark, tmp_path)
    e.create_view("v", "SELECT state, count(*) AS n FROM city.rides GROUP BY state")
    e.run_pending()
    commit([(RIDES, "I", None, row(RIDES, 10, 1, 1, 1, "open"))])
    q = maintain(e, str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(map(tuple, e.read("v").collect())) == [("done", 2), ("open", 2)]


def test_a_table_without_a_key_is_compacted(spark, tmp_path, monkeypatch):
    """Rows that are there several times, nulls, values that weren't sent and a truncation, past many changes and a refresh."""
    monkeypatch.setattr(delta, "COPIES", 3)
    e = Engine(spark, str(tmp_path / "root"), compact_changes=3)
    e.register_table("t", spark.createDataFrame([(1, 5)] * 7 + [(None, 2), (2, None)], "k int, x int"))
    e.create_view("v", "SELECT k, count(*) AS n, sum(x) AS x FROM t GROUP BY k")
    e.run_pending()
    schemas, r = {"public.t": e.table_schema("t")}, lambda k, x: {"k": k, "x": x}
    commit = lambda *txs: (e.log.commit([[("public.t", *c) for c in t] for t in txs], schemas), e.drain())
    rows = lambda: sorted(map(tuple, e.read("v").collect()), key=str)
    commit([("D", r(1, 5), None), ("I", None, r(None, 2))], [("U", r(1, 5), r(3, None), ["x"]), ("I", None, r(3, 5)), ("D", r(2, None), None)])
    assert e.manifest["tables"]["public.t"]["from"] == 2
    assert sorted(map(tuple, e._base("public.t", 2).collect()), key=str) == [(1, 5)] * 5 + [(3, 5)] * 2 + [(None, 2)] * 2
    assert rows() == [(1, 5, 25), (3, 2, 10), (None, 2, 4)]
    commit([("I", None, r(1, 5))] * 3)
    e.refresh("v")
    e.run_pending()
    assert rows() == [(1, 8, 40), (3, 2, 10), (None, 2, 4)]
    commit([("T", None, None)], [("I", None, r(4, 4)), ("I", None, r(4, 4))])
    e.refresh("v")
    e.run_pending()
    assert rows() == [(4, 2, 8)]
