"""Queries over the standard tables that exercise the engine, each with the SQL of what it must give.

Base tables are derived from ``orders``, ``customer``, ``nation``, ``lineitem``, ``part`` and ``events``. A change stream
follows from a row's key: of key % 10, 0 to 6 are there at first, 7 and 8 are inserted, 1 gets one cent more, 2 moves to
another group, 4 leaves the filter, 3 is deleted, 9 never appears. The transaction is key % 8 + 1. So the final rows, and
those as of every transaction, can be said in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ViewError
from .sources.store import workspace
from .streaming.engine import SETTINGS, Engine

#: The base tables, in SQL that Spark and DuckDB both run.
TABLES = {
    "orders": "SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents, NULLIF(o_orderpriority, '1-URGENT') AS priority FROM orders",
    "customers": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer",
    "nations": "SELECT n_nationkey AS nation, n_name AS nation_name, n_regionkey AS region FROM nation",
    "items": "SELECT DISTINCT l_orderkey AS ord, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_shipdate AS shipped, CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag FROM lineitem",
    "parts": "SELECT p_partkey AS part, p_brand AS brand, NULLIF(p_size, 1) AS size, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS price FROM part",
    "events": "SELECT event_id AS id, user_id AS usr, event_type AS kind, CAST(ROUND(value * 100) AS BIGINT) AS amount FROM events",
}
KEYS = {"orders": ["id"], "customers": ["id"], "nations": ["nation"], "items": ["ord", "part", "supp", "line", "shipped"], "parts": ["part"], "events": ["id"]}
SOURCES = {"orders": ["orders"], "customers": ["customer"], "nations": ["nation"], "items": ["lineitem"], "parts": ["part"], "events": ["events"]}

MOVED = "CASE status WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE 'F' END"
#: What an update makes of a row of orders.
STATUS = f"CASE WHEN id % 10 = 2 THEN {MOVED} WHEN id % 10 = 4 THEN 'V' ELSE status END"
CENTS = "CASE WHEN id % 10 = 1 THEN cents + 1 ELSE cents END"
PHASES = {"insert": "I", "update": "U", "delete": "D", "mixed": "IUD"}
#: For feeds that are read from their first row: retention as long as it goes. Engines keep 100,000 rows by default.
WHOLE = SETTINGS["retain_deltas"][2]


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    session = spark.newSession()
    for n in {t for name in names for t in SOURCES[name]}:
        session.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
    return {n: session.sql(TABLES[n]) for n in names}


def order_changes(orders: DataFrame, phase: str) -> DataFrame:
    """The change stream of a phase, as a segment's frame."""
    names = orders.columns
    old = F.struct(*names)
    new = F.struct(*[F.expr({"status": STATUS, "cents": CENTS}.get(c, c)).alias(c) for c in names])
    rest = F.col("id") % 10
    op = F.when(rest.isin(7, 8) & F.lit("I" in PHASES[phase]), "I").when(rest.isin(1, 2, 4) & F.lit("U" in PHASES[phase]), "U").when((rest == 3) & F.lit("D" in PHASES[phase]), "D")
    rows = orders.withColumn("op", op).where("op is not null")
    return rows.select((F.col("id") % 8 + 1).alias("lsn"), (F.col("id") % 8 + 1001).alias("xid"), F.col("id").cast("int").alias("ord"), "op", F.when(F.col("op") != "I", old).alias("before"), F.when(F.col("op") == "U", new).when(F.col("op") == "I", old).alias("after"))


def orders_after(phase: str | None, upto: int = 8) -> str:
    """SQL of the rows of orders after the transactions up to one."""
    ops = PHASES[phase] if phase else ""
    done = f"(id % 8 + 1 <= {upto})"
    there = "id % 10 < 7" + (f" OR (id % 10 IN (7, 8) AND {done})" if "I" in ops else "")
    gone = f" AND NOT (id % 10 = 3 AND {done})" if "D" in ops else ""
    status, cents = (f"CASE WHEN {done} THEN {STATUS} ELSE status END", f"CASE WHEN {done} THEN {CENTS} ELSE cents END") if "U" in ops else ("status", "cents")
    return f"SELECT id, cust, {status} AS status, {cents} AS cents, priority FROM ({TABLES['orders']}) t WHERE ({there}){gone}"


def _engine(spark: SparkSession, sf_dir: str, *names: str, start: bool = True, **settings) -> tuple[Engine, dict[str, DataFrame]]:
    found = _tables(spark, sf_dir, *names)
    engine = Engine(spark, workspace(spark), **settings)
    for n, df in found.items():
        engine.register_table(n, df.where("id % 10 < 7") if n == "orders" and start else df, KEYS[n])
    return engine, found


#: Views: base tables and definition. The definition is also its own oracle over the tables' SQL.
VIEWS = {
    "proj": (("orders",), "SELECT id, cust, cents FROM orders WHERE status = 'F'"),
    "proj_expr": (("orders",), "SELECT id, cents * 2 AS twice, lower(status) AS s, id % 7 AS r FROM orders WHERE status <> 'V' AND cents > 100000"),
    "agg": (("orders",), "SELECT status, count(*) AS n, sum(cents) AS total FROM orders WHERE status <> 'V' GROUP BY status"),
    "agg_nulls": (("orders",), "SELECT priority, count(*) AS n, count(priority) AS some, sum(CASE WHEN status = 'F' THEN cents END) AS f FROM orders GROUP BY priority"),
    "agg_expr_key": (("events",), "SELECT usr % 10 AS bucket, kind, sum(amount) AS total, count(amount) AS n FROM events GROUP BY usr % 10, kind"),
    "join2": (("orders", "customers"), "SELECT o.id, c.name, c.segment, o.cents FROM orders o JOIN customers c ON c.id = o.cust WHERE o.status <> 'V'"),
    "join3": (("orders", "customers", "nations"), "SELECT o.id, c.name, n.nation_name, o.cents FROM orders o, customers c, nations n WHERE c.id = o.cust AND n.nation = c.nation AND o.status = 'O'"),
    "join3_agg": (("orders", "customers", "nations"), "SELECT n.nation_name, count(*) AS n, sum(o.cents) AS total FROM orders o JOIN customers c ON c.id = o.cust JOIN nations n ON n.nation = c.nation WHERE o.status <> 'V' GROUP BY n.nation_name"),
    "join_using": (("customers", "nations"), "SELECT c.id, nation, n.nation_name FROM customers c JOIN nations n USING (nation)"),
    "join_theta": (("customers", "nations"), "SELECT c.segment, n.region, count(*) AS n FROM customers c JOIN nations n ON c.nation < n.nation AND n.region = 1 GROUP BY c.segment, n.region"),
    "join_cross": (("nations", "parts"), "SELECT n.region, p.brand, count(*) AS n, count(p.size) AS sized FROM nations n CROSS JOIN parts p GROUP BY n.region, p.brand"),
    "star": (("customers",), "SELECT * FROM customers"),
    "two_counts": (("orders",), "SELECT status, count(*) AS n, count(1) AS ones FROM orders GROUP BY status"),
    "items_revenue": (("items", "parts"), "SELECT p.brand, i.flag, count(*) AS n, sum(i.qty * p.price) AS revenue FROM items i JOIN parts p ON p.part = i.part GROUP BY p.brand, i.flag"),
}


def validate(engine: Engine, definition: str):
    """The spec of a definition over an engine's tables."""
    from .plans.shape import validate as check

    return check(engine.session, definition, engine._facts())


def _sql(view: str, orders: str | None = None, customers: str | None = None) -> str:
    """The definition over the tables' SQL; sums are BIGINT in Spark."""
    tables, definition = VIEWS[view]
    parts = [f"b_{t} AS ({ {'orders': orders, 'customers': customers}.get(t) or TABLES[t]})" for t in tables]
    import re

    body = definition
    for t in tables:
        body = re.sub(rf"\b(FROM|JOIN|,)\s+{t}\b(?!\s*\.)(\s+(?!WHERE|GROUP|JOIN|CROSS|ON|USING)\w+)?", lambda m, t=t: f"{m[1]} b_{t}{m[2] or f' {t}'}", body)
    body = re.sub(r"\bsum\(((?:[^()]|\([^()]*\))*)\)", r"CAST(sum(\1) AS BIGINT)", body)
    return f"WITH {', '.join(parts)} {body}"


def _built(view: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables, definition = VIEWS[view]
        engine, _ = _engine(spark, sf_dir, *tables, start=False)
        engine.create_view("v", definition)
        engine.run_pending()
        engine.await_ready("v", 0)
        return engine.read("v")

    return query


def maintained(spark: SparkSession, sf_dir: str, view: str, phase: str, **settings) -> Engine:
    """An engine whose view ``v`` was built, and then brought up to date with a phase of changes, in two rounds."""
    tables, definition = VIEWS[view]
    engine, found = _engine(spark, sf_dir, *tables, **settings)
    engine.create_view("v", definition)
    engine.run_pending()
    engine.await_ready("v", 0)
    changes = order_changes(found["orders"], phase)
    for low, high in ((1, 4), (5, 8)):
        engine.log.append({"public.orders": changes.where(F.col("lsn").between(low, high))})
        engine.drain()
    engine.await_ready("v", 0)
    return engine


def _maintained(view: str, phase: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: maintained(spark, sf_dir, view, phase).read("v")


def _whole_feed(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The feed of a view over mixed changes, from its first row to its last, however many there are."""
    return maintained(spark, sf_dir, view, "mixed", retain_deltas=WHOLE).changes("v", 0, 1, WHOLE)


def _feed(view: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _whole_feed(spark, sf_dir, view)
        return rows.select("lsn", "xid", "op", "row.*")

    return query


def _feed_sql(view: str) -> str:
    """Rows that differ between one transaction and the next."""
    import re

    parts = []
    for t in range(1, 9):
        before, after = (re.sub(r"\bb_(\w+)", rf"b{t}{k}_\1", _sql(view, orders_after("mixed", t - d))) for k, d in (("a", 1), ("b", 0)))
        for op, one, other in (("D", before, after), ("I", after, before)):
            parts.append(f"SELECT CAST({t} AS BIGINT) AS lsn, CAST({t + 1000} AS BIGINT) AS xid, '{op}' AS op, x.* FROM (SELECT * FROM ({one}) p EXCEPT ALL SELECT * FROM ({other}) q) x")
    return " UNION ALL ".join(parts)


def dim_update_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer in 50 changes its segment: all of its orders' rows change."""
    tables, definition = VIEWS["join2"]
    engine, found = _engine(spark, sf_dir, *tables)
    engine.create_view("v", definition)
    engine.run_pending()
    c = found["customers"].where("id % 50 = 0")
    new = F.struct(*[(F.lit("MOVED") if n == "segment" else F.col(n)).alias(n) for n in c.columns])
    engine.log.append({"public.customers": c.select((F.col("id") % 3 + 1).alias("lsn"), (F.col("id") % 3 + 1).alias("xid"), F.col("id").cast("int").alias("ord"), F.lit("U").alias("op"), F.struct(*c.columns).alias("before"), new.alias("after"))})
    engine.drain()
    return engine.read("v")


def empty_group_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of one status are deleted: its group goes."""
    tables, definition = VIEWS["agg"]
    engine, found = _engine(spark, sf_dir, *tables, start=False)
    engine.create_view("v", definition)
    engine.run_pending()
    o = found["orders"].where("status = 'P'")
    engine.log.append({"public.orders": o.select(F.lit(1).cast("long").alias("lsn"), F.lit(1).cast("long").alias("xid"), F.col("id").cast("int").alias("ord"), F.lit("D").alias("op"), F.struct(*o.columns).alias("before"), F.lit(None).cast(o.select(F.struct(*o.columns).alias("s")).schema["s"].dataType).alias("after"))})
    engine.drain()
    return engine.read("v")


def feed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's first rows with its feed applied: the view's rows again."""
    tables, definition = VIEWS["proj"]
    first = spark.newSession()
    for n, df in _tables(spark, sf_dir, *tables).items():
        first = df.sparkSession
        df.where("id % 10 < 7").createOrReplaceTempView(f"start_{n}")
    start = first.sql(definition.replace("FROM orders", "FROM start_orders"))
    feed = _whole_feed(spark, sf_dir, "proj").select("op", "row.*")
    signed = start.select("*", F.lit(1).alias("w")).unionByName(feed.select(*start.columns, F.when(F.col("op") == "I", 1).otherwise(-1).alias("w")))
    return signed.groupBy(*start.columns).agg(F.sum("w").alias("w")).where("w > 0").drop("w")


def changes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the feed: it ends with a transaction, not with a row."""
    rows = maintained(spark, sf_dir, "agg", "mixed").changes("v", 0, 1, 1)
    return rows.groupBy("lsn").agg(F.count("*").alias("n"))


def status_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = maintained(spark, sf_dir, "agg", "insert").status("v")
    return spark.createDataFrame([(s["name"], s["status"], s["epoch"], s["frontier_lsn"], s["frontier"])], "name string, status string, epoch int, frontier_lsn long, frontier string")


def hidden_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage with its hidden counters."""
    engine, _ = _engine(spark, sf_dir, "events", start=False)
    engine.create_view("v", VIEWS["agg_expr_key"][1])
    engine.run_pending()
    return engine.storage("v")


def _const(frame: DataFrame, op: str, lsn: int, before: bool, after: bool) -> DataFrame:
    """All rows of a frame as changes of one transaction; ``ord`` is the row's id."""
    row = F.struct(*frame.columns)
    none = F.lit(None).cast(frame.select(row.alias("r")).schema["r"].dataType)
    long = lambda v: F.lit(v).cast("long")
    return frame.select(long(lsn).alias("lsn"), long(lsn).alias("xid"), F.col("id").cast("int").alias("ord"), F.lit(op).alias("op"), (row if before else none).alias("before"), (row if after else none).alias("after"))


def refresh_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh after changes: the same rows, a new epoch."""
    engine = maintained(spark, sf_dir, "agg", "mixed")
    engine.refresh("v")
    engine.run_pending()
    return engine.read("v").withColumn("epoch", F.lit(engine.status("v")["epoch"]))


def truncate_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRUNCATE makes the view stale; rows that come later are what a refresh finds."""
    engine, found = _engine(spark, sf_dir, "orders", start=False)
    engine.create_view("v", VIEWS["agg"][1])
    engine.run_pending()
    engine.log.append({"public.orders": _const(found["orders"].limit(1), "T", 1, False, False)})
    engine.drain()
    assert engine.status("v")["status"] == "stale"
    engine.log.append({"public.orders": _const(found["orders"].where("id % 10 = 7"), "I", 2, False, True)})
    engine.refresh("v")
    engine.drain()
    return engine.read("v")


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column goes: views that use it are stale, others are not."""
    engine, found = _engine(spark, sf_dir, "orders", start=False)
    engine.create_view("with_cents", VIEWS["proj"][1])
    engine.create_view("without", "SELECT id, status FROM orders")
    engine.run_pending()
    engine.alter_table("orders", found["orders"].drop("cents"))
    rows = [(engine.status(v)["name"], engine.status(v)["status"], engine.status(v)["stale_reason"]) for v in ("with_cents", "without")]
    return spark.createDataFrame(rows, "name string, status string, stale_reason string")


def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that a change makes fail stops before that transaction and is stale after three rounds; the other goes on."""
    engine, found = _engine(spark, sf_dir, "orders")
    engine.create_view("good", "SELECT id, status FROM orders")
    engine.create_view("bad", "SELECT id, 1000 div cents AS d FROM orders")
    engine.run_pending()
    late = found["orders"].where("id % 10 = 7").withColumn("cents", F.expr("case when id % 50 = 17 then 0 else cents end"))
    engine.log.append({"public.orders": _const(late, "I", 1, False, True).withColumn("lsn", F.expr("if(after.cents = 0, 3L, 1L + after.id % 2)")).withColumn("xid", F.col("lsn"))})
    engine.drain()
    out = [(s["name"], s["status"], s["frontier_lsn"]) for s in map(engine.status, ("good", "bad"))]
    counts = {v: engine.read(v).count() for v in ("good", "bad")}
    return spark.createDataFrame([(*x, counts[n]) for x, n in zip(out, ("good", "bad"), strict=True)], "name string, status string, frontier long, n long")


def keyless_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a table without a key, in which rows may repeat, after inserts, updates and deletes."""
    session = _tables(spark, sf_dir, "orders")["orders"].select("id", "status", "cents")
    engine = Engine(spark, workspace(spark))
    engine.register_table("orders", session.where("id % 10 < 7"))
    engine.create_view("v", "SELECT status, count(*) AS n, sum(cents) AS total FROM orders GROUP BY status")
    engine.run_pending()
    engine.log.append({"public.orders": order_changes(session, "mixed")})
    engine.drain()
    return engine.read("v")


def unchanged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates whose unchanged columns weren't sent: they keep their values."""
    tables, definition = VIEWS["join2"]
    engine, found = _engine(spark, sf_dir, *tables)
    engine.create_view("v", definition)
    engine.run_pending()
    changes = order_changes(found["orders"], "update")
    sent = F.struct(*[(F.lit(None).cast("int") if c == "cust" else F.lit(None).cast("string") if c == "priority" else F.col(f"after.{c}")).alias(c) for c in found["orders"].columns])
    kinds = changes.schema["after"].dataType
    engine.log.append({"public.orders": changes.withColumn("after", sent.cast(kinds)).withColumn("unchanged", F.array(F.lit("cust"), F.lit("priority")))})
    engine.drain()
    return engine.read("v")


def _both_changed(spark: SparkSession, sf_dir: str) -> Engine:
    """In one transaction customers move, and orders come, change and go."""
    tables, definition = VIEWS["join3_agg"]
    engine, found = _engine(spark, sf_dir, *tables)
    engine.create_view("v", definition)
    engine.run_pending()
    c = found["customers"].where("id % 3 = 0")
    new = F.struct(*[(F.expr("(nation + 1) % 25").cast(c.schema[n].dataType) if n == "nation" else F.col(n)).alias(n) for n in c.columns])
    one = lambda df: df.withColumn("lsn", F.lit(1).cast("long")).withColumn("xid", F.lit(1).cast("long"))
    moved = _const(c, "U", 1, True, False).drop("after").join(c.select(F.col("id").cast("int").alias("ord"), new.alias("after")), "ord")
    engine.log.append({"public.customers": moved, "public.orders": one(order_changes(found["orders"], "mixed"))})
    engine.drain()
    return engine


def dim_and_fact_same_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_changed(spark, sf_dir).read("v")


def feed_same_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its feed: each group once before and once after, whatever went on between."""
    return _both_changed(spark, sf_dir).changes("v", 0, 1, 1 << 30).select("lsn", "xid", "op", "row.*")


def feed_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with its numbers: by transaction, row and the row before ahead of that after."""
    return _whole_feed(spark, sf_dir, "proj").select("seq", "lsn", "op", "row.*")


def stream_maintain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view kept current by a streaming query over the log."""
    from .streaming.stream import maintain

    tables, definition = VIEWS["join3_agg"]
    engine, found = _engine(spark, sf_dir, *tables)
    engine.create_view("v", definition)
    engine.run_pending()
    changes = order_changes(found["orders"], "mixed")
    for low, high in ((1, 3), (4, 8)):
        engine.log.append({"public.orders": changes.where(F.col("lsn").between(low, high))})
        query = maintain(engine, f"{engine.root}/checkpoint")
        query.awaitTermination()
    return engine.read("v")


def subscription_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber holds who took the snapshot and then each transaction; the view has a row for each status."""
    from .streaming.client import Snapshot, Subscription, Transaction

    tables, definition = VIEWS["agg"]
    engine, found = _engine(spark, sf_dir, *tables)
    engine.create_view("v", definition)
    engine.run_pending()
    follower, held = Subscription(engine, "v"), set()
    changes = order_changes(found["orders"], "mixed")
    for high in (0, 4, 8):
        if high:
            engine.log.append({"public.orders": changes.where(F.col("lsn").between(high - 3, high))})
            engine.drain()
        for event in follower.poll():
            if isinstance(event, Snapshot):
                held = {tuple(r) for r in event.rows.collect()}
            elif isinstance(event, Transaction):
                for d in event.deltas:
                    (held.add if d["op"] == "I" else held.remove)(tuple(d["row"]))
    follower.close()
    return spark.createDataFrame(sorted(held), engine.read("v").schema)


def feed_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded feed: an old cursor is told so, and where the feed begins; what is kept is whole and ends with the view."""
    tables, definition = VIEWS["agg"]
    engine, found = _engine(spark, sf_dir, *tables)
    engine.settings["retain_deltas"] = 4
    engine.create_view("v", definition)
    engine.run_pending()
    engine.log.append({"public.orders": order_changes(found["orders"], "mixed")})
    engine.drain()
    try:
        engine.changes("v", 0, 1)
        code = None
    except ViewError as e:
        code = e.code
    last = engine.current_seq("v")
    return spark.createDataFrame([(code, engine.changes("v", last - 4, 1, 1 << 20).count())], "code string, kept long")


def two_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines on one folder: each view, whoever made it, is there, built and kept current."""
    engine, found = _engine(spark, sf_dir, "orders")
    other = Engine(spark, engine.root)
    engine.create_view("one", VIEWS["agg"][1])
    other.create_view("two", "SELECT status, count(*) AS n FROM orders GROUP BY status")
    engine.run_pending()
    engine.log.append({"public.orders": order_changes(found["orders"], "mixed")})
    other.drain()
    engine.drain()
    rows = engine.read("one").select(F.lit("one").alias("view"), "status", "n").unionByName(engine.read("two").select(F.lit("two").alias("view"), "status", "n"))
    return rows


def snapshot_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame that was read before eight rounds of changes still has its rows after them."""
    tables, definition = VIEWS["proj"]
    engine, found = _engine(spark, sf_dir, *tables)
    engine.create_view("v", definition)
    engine.run_pending()
    rows = engine.read("v")
    changes = order_changes(found["orders"], "mixed")
    for lsn in range(1, 9):
        engine.log.append({"public.orders": changes.where(F.col("lsn") == lsn)})
        engine.drain()
    return rows


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition with a function of the user's."""
    engine, found = _engine(spark, sf_dir, "orders")
    engine.register_function("marked", lambda s: None if s is None else f"<{s}>", "string")
    engine.create_view("v", "SELECT marked(status) AS m, count(*) AS n FROM orders GROUP BY marked(status)")
    engine.run_pending()
    engine.log.append({"public.orders": order_changes(found["orders"], "mixed")})
    engine.drain()
    return engine.read("v")


#: Definitions that are refused, over orders, customers and a table without a key.
REFUSED = [
    "SELECT id FROM orders UNION ALL SELECT id FROM customers", "WITH x AS (SELECT id FROM orders) SELECT id FROM x", "SELECT id, rank() OVER (ORDER BY cents) AS r FROM orders", "SELECT DISTINCT status FROM orders",
    "SELECT id FROM orders ORDER BY id", "SELECT id FROM orders LIMIT 3", "SELECT status, count(*) AS n FROM orders GROUP BY status HAVING count(*) > 1", "SELECT status, count(*) AS n FROM orders GROUP BY ROLLUP (status)",
    "SELECT id, explode(array(1, 2)) AS e FROM orders", "SELECT * FROM VALUES (1)", "SELECT id FROM orders WHERE cust IN (SELECT id FROM customers)", "SELECT x.id FROM (SELECT id FROM orders) x",
    "SELECT o.id FROM orders o LEFT JOIN customers c ON c.id = o.cust", "SELECT o.id FROM orders o RIGHT JOIN customers c ON c.id = o.cust", "SELECT o.id FROM orders o FULL JOIN customers c ON c.id = o.cust", "SELECT o.id FROM orders o LEFT SEMI JOIN customers c ON c.id = o.cust",
    "SELECT o.id FROM orders o LEFT ANTI JOIN customers c ON c.id = o.cust", "SELECT a.id FROM orders a JOIN orders b ON a.id = b.cust", "SELECT o.id FROM orders o, LATERAL (SELECT o.cust) x", "SELECT o.id FROM orders o JOIN bare b ON b.a = o.id",
    "SELECT status, avg(cents) AS a FROM orders GROUP BY status", "SELECT status, min(cents) AS a FROM orders GROUP BY status", "SELECT status, max(cents) AS a FROM orders GROUP BY status", "SELECT status, count(DISTINCT cust) AS a FROM orders GROUP BY status",
    "SELECT status, sum(cents) FILTER (WHERE cents > 1) AS a FROM orders GROUP BY status", "SELECT status, sum(cents) * 2 AS a FROM orders GROUP BY status", "SELECT count(*) AS n FROM orders", "SELECT status FROM orders GROUP BY status", "SELECT count(*) AS n FROM orders GROUP BY status",
    "SELECT status, count(*) AS a, count(*) AS b FROM orders GROUP BY status", "SELECT cust FROM orders", "SELECT a, b FROM bare", "SELECT id, current_timestamp() AS t FROM orders", "SELECT id FROM orders WHERE rand() < 0.5", "SELECT id, cust AS id FROM orders", "SELECT id, cust AS __ivm_x FROM orders",
    "SELECT id, nothing FROM orders", "SELECT id FROM nowhere", "SELECT id, struct(*) AS w FROM orders", "SELECT id, struct(orders.*) AS w FROM orders", "INSERT INTO orders SELECT * FROM orders", "SELECT id FROM orders FOR UPDATE", "SELECT id FROM orders TABLESAMPLE (5 PERCENT)", "",
]
ACCEPTED = ["SELECT id, cust FROM orders", "SELECT status, count(*) AS n, count(1) AS m FROM orders GROUP BY status", "SELECT a, count(*) AS n FROM bare GROUP BY a"]


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each definition: the code of its refusal, null if it is accepted."""
    engine, _ = _engine(spark, sf_dir, "orders", "customers", start=False)
    engine.register_table("bare", spark.createDataFrame([], "a int, b int"))
    rows = []
    for definition in [*REFUSED, *ACCEPTED]:
        try:
            validate(engine, definition)
            rows.append((definition, None))
        except ViewError as e:
            rows.append((definition, e.code))
    return spark.createDataFrame(rows, "definition string, code string")


def write_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of writes that aren't the engine's own."""
    engine, found = _engine(spark, sf_dir, "orders")
    engine.create_view("v", VIEWS["agg"][1])
    engine.run_pending()
    engine.publish("v")
    rows = []
    for what, write in (("insert_into", lambda: engine.insert_into("v")), ("sql", lambda: engine.sql("INSERT INTO v SELECT * FROM v")), ("truncate", lambda: engine.sql("TRUNCATE TABLE v")), ("read", lambda: engine.sql("SELECT count(*) FROM v").collect())):
        try:
            write()
            rows.append((what, None))
        except ViewError as e:
            rows.append((what, e.code))
    return spark.createDataFrame(rows, "what string, code string")


MORE = (
    refresh_epoch, truncate_rebuild, drift, isolation, keyless_agg, unchanged_values, dim_and_fact_same_tx, feed_same_tx, feed_numbered, stream_maintain, subscription_replay, feed_retention, two_engines, snapshot_stays,
    user_function, refused, write_guard,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {f"build_{v}": _built(v) for v in VIEWS}
    for view in ("proj", "agg", "join2", "join3_agg"):
        for phase in PHASES:
            out[f"maintain_{view}_{phase}"] = _maintained(view, phase)
    out["maintain_agg_nulls_mixed"] = _maintained("agg_nulls", "mixed")
    for view in ("proj", "agg", "join2"):
        out[f"feed_{view}"] = _feed(view)
    return out | {f.__name__: f for f in (dim_update_fanout, empty_group_removed, feed_replay, changes_page, status_row, hidden_columns, *MORE)}


def oracle_sql() -> dict[str, str]:
    out = {f"build_{v}": _sql(v) for v in VIEWS}
    for view in ("proj", "agg", "join2", "join3_agg"):
        for phase in PHASES:
            out[f"maintain_{view}_{phase}"] = _sql(view, orders_after(phase))
    out["maintain_agg_nulls_mixed"] = _sql("agg_nulls", orders_after("mixed"))
    for view in ("proj", "agg", "join2"):
        out[f"feed_{view}"] = _feed_sql(view)
    moved = f"SELECT id, name, CASE WHEN id % 50 = 0 THEN 'MOVED' ELSE segment END AS segment, nation FROM ({TABLES['customers']}) t"
    out["dim_update_fanout"] = _sql("join2", orders_after(None), moved)
    out["empty_group_removed"] = _sql("agg", f"SELECT * FROM ({TABLES['orders']}) t WHERE status <> 'P'")
    out["feed_replay"] = _sql("proj", orders_after("mixed"))
    out["changes_page"] = f"SELECT lsn, count(*) AS n FROM ({_feed_sql('agg')}) f WHERE lsn = (SELECT min(lsn) FROM ({_feed_sql('agg')}) g) GROUP BY lsn"
    out["status_row"] = "SELECT 'public.v' AS name, 'live' AS status, 1 AS epoch, CAST(8 AS BIGINT) AS frontier_lsn, '0/8' AS frontier"
    out["hidden_columns"] = f"SELECT bucket, kind, CAST(sum(amount) AS BIGINT) AS total, count(amount) AS n, count(amount) AS __ivm_nn_0, count(*) AS __ivm_n FROM (SELECT usr % 10 AS bucket, kind, amount FROM ({TABLES['events']}) t) u GROUP BY bucket, kind"
    mixed, feed = orders_after("mixed"), _feed_sql("proj")
    out["refresh_epoch"] = f"SELECT *, 2 AS epoch FROM ({_sql('agg', mixed)}) t"
    out["truncate_rebuild"] = _sql("agg", f"SELECT * FROM ({TABLES['orders']}) t WHERE id % 10 = 7")
    out["drift"] = "SELECT * FROM (VALUES ('public.with_cents', 'stale', 'column cents of public.orders was dropped, renamed or changed type'), ('public.without', 'live', NULL)) AS t(name, status, stale_reason)"
    start = f"SELECT count(*) FROM ({TABLES['orders']}) t WHERE id % 10 < 7"
    come = f"SELECT count(*) FROM ({TABLES['orders']}) t WHERE id % 10 = 7"
    out["isolation"] = f"SELECT 'public.good' AS name, 'live' AS status, CAST(3 AS BIGINT) AS frontier, ({start}) + ({come}) AS n UNION ALL SELECT 'public.bad', 'stale', CAST(2 AS BIGINT), ({start}) + ({come} AND id % 50 <> 17)"
    out["keyless_agg"] = _sql("agg", mixed).replace("WHERE status <> 'V'", "")
    out["unchanged_values"] = _sql("join2", orders_after("update"))
    nation = f"SELECT id, name, segment, CASE WHEN id % 3 = 0 THEN (nation + 1) % 25 ELSE nation END AS nation FROM ({TABLES['customers']}) t"
    before, after = _sql("join3_agg", orders_after(None)), _sql("join3_agg", mixed, nation)
    out["dim_and_fact_same_tx"] = after
    both = [f"SELECT CAST(1 AS BIGINT) AS lsn, CAST(1 AS BIGINT) AS xid, '{op}' AS op, x.* FROM (SELECT * FROM ({a}) p EXCEPT ALL SELECT * FROM ({b}) q) x" for op, a, b in (("D", before, after), ("I", after, before))]
    out["feed_same_tx"] = " UNION ALL ".join(both)
    out["feed_numbered"] = f"SELECT row_number() OVER (ORDER BY lsn, id, op) AS seq, lsn, op, id, cust, cents FROM ({feed}) f"
    out["stream_maintain"] = _sql("join3_agg", mixed)
    out["subscription_replay"] = _sql("agg", mixed)
    out["feed_retention"] = "SELECT 'IV001' AS code, CAST(4 AS BIGINT) AS kept"
    two = f"SELECT status, count(*) AS n FROM ({mixed}) t"
    out["two_engines"] = f"SELECT 'one' AS view, status, n FROM ({two} WHERE status <> 'V' GROUP BY status) a UNION ALL SELECT 'two', status, n FROM ({two} GROUP BY status) b"
    out["snapshot_stays"] = _sql("proj", orders_after(None))
    out["user_function"] = f"SELECT '<' || status || '>' AS m, count(*) AS n FROM ({mixed}) t GROUP BY status"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out["refused"] = "SELECT * FROM (VALUES " + ", ".join([f"({quote(x)}, 'IV004')" for x in REFUSED] + [f"({quote(x)}, NULL)" for x in ACCEPTED]) + ") AS t(definition, code)"
    out["write_guard"] = "SELECT * FROM (VALUES ('insert_into', 'IV005'), ('sql', 'IV005'), ('truncate', 'IV005'), ('read', NULL)) AS t(what, code)"
    return out
