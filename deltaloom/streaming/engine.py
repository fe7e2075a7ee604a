"""The engine: registered tables, views, and rounds that bring views up to date with the change log.

All that a round makes (states, feeds, positions) is written to new folders; one manifest, a numbered file that is written
once, names them. So a view, its position and its feed always change together, a crash leaves the old manifest, and a
reader that holds one sees one consistent point: what it names stays for ``keep_seconds`` after it was replaced. Of two
engines on a folder that commit at once one is first; the other undoes what it did and goes on from the first one's.

States and shadows lie in buckets by the hash of their identity; a round reads and writes the buckets it touches.

Tables used by join views have a shadow: their key and used columns at a position of their own, by key, and once more by
each set of columns that views join them on, so a round reads the buckets with the join keys of the changed rows only. A
view is advanced from its own position over shadow versions by position, so a view that was held up by an error catches
up exactly, whatever the other views have reached.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BuildFailed, Conflict, DirectWrite, EpochChanged, Exists, Lagged, NotFound, Stale, Unsupported, ViewError
from ..functions.names import canonical, format_position, parse_position
from ..operators import delta as D
from ..plans.shape import ViewSpec, targets, validate, view_name
from ..sources import buckets as B
from ..sources.changelog import ChangeLog
from ..sources.store import Store

#: Settings: default, least and greatest value.
SETTINGS = {
    "poll_interval_ms": (100, 10, 60_000), "retain_deltas": (100_000, 1, 1 << 40), "max_pending_changes": (50_000_000, 1, 1 << 50), "max_apply_failures": (3, 1, 1000),
    "batch_changes": (5_000_000, 1, 1 << 40), "keep_seconds": (600, 0, 1 << 30), "views_at_once": (8, 1, 256), "bucket_bytes": (64 << 20, 1 << 10, 1 << 40), "compact_changes": (5_000_000, 1, 1 << 50),
}
#: Net changes that one task may sort; most stretches of a batch's positions that groups' running sums go in.
ALONE, PARTS = 100_000, 64
EMPTY = {"version": 0, "tables": {}, "views": {}, "shadows": {}, "offset": 0, "trash": []}


class Engine:
    def __init__(self, spark: SparkSession, root: str, **settings):
        for name, value in settings.items():
            if name not in SETTINGS:
                raise ValueError(f"no such setting: {name}")
            low, high = SETTINGS[name][1:]
            if not low <= value <= high:
                raise ValueError(f"{name} must be from {low} to {high}, not {value}")
        self.spark, self.root = spark, root.rstrip("/")
        self.settings = {n: d[0] for n, d in SETTINGS.items()} | settings
        self.store, self.log = Store(spark, root), ChangeLog(spark, root)
        self.listeners: list[Callable[[str, int, int], None]] = []
        self.manifest: dict = json.loads(json.dumps(EMPTY))
        self._made: list[str] = []
        self._shown: dict[str, str] = {}
        self._session()
        self._reload()

    def _session(self) -> None:
        """The session that definitions are checked in: the caller's functions, and empty frames under the tables' names."""
        self.session = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        for name in self._shown:
            self._show(name)

    def register_function(self, name: str, f, returns=None) -> None:
        """A user's function for definitions, for as long as the Spark session lives. It must be deterministic; one that is
        marked as not being so is refused where a definition uses it."""
        self.spark.udf.register(name, f, returns) if returns is not None else self.spark.udf.register(name, f)
        self._session()

    # Tables

    def register_table(self, name: str, source: DataFrame | str, primary_key: list[str] | None = None) -> str:
        """A base table: its rows before the first change of the log (a frame, which is written, or a Parquet path that
        is read as it is), and its key."""
        name = canonical(name)
        if isinstance(source, str):
            path, schema = source, self.spark.read.parquet(source).schema
        else:
            path, schema = self._write(source, "base"), source.schema
        missing = set(primary_key or []) - set(schema.names)
        if missing:
            raise ValueError(f"no column {sorted(missing)} in {name}")

        def add() -> str:
            if name in self.manifest["tables"]:
                raise Exists(f"table {name} is registered")
            self.manifest["tables"][name] = {"path": path, "schema": schema.json(), "key": list(primary_key or []), "from": self.log.end()}
            return name

        return self._change(add)

    def alter_table(self, name: str, source: DataFrame) -> list[str]:
        """The table as it is now, with another schema. Views that use a column that is gone or of another type become
        stale and are returned; others don't notice."""
        path = self._write(source, "base")
        types = {f.name: f.dataType.simpleString() for f in source.schema}

        def alter() -> list[str]:
            table_name = self._table(name)
            table = self.manifest["tables"][table_name]
            table |= {"path": path, "schema": source.schema.json(), "from": self.log.end(), "key": [k for k in table["key"] if k in types]}
            hit = []
            for view, v in self.manifest["views"].items():
                for r in ViewSpec.from_json(v["spec"]).relations if v.get("spec") else []:
                    lost = [c for c, kind in r.types.items() if types.get(c) != kind] if r.table == table_name else []
                    if lost:
                        self._stale(v, f"column {lost[0]} of {table_name} was dropped, renamed or changed type")
                        hit.append(view)
            if table_name in self.manifest["shadows"]:
                shadow = self.manifest["shadows"][table_name]
                live = [v["frontier"] for v in self.manifest["views"].values() if v["status"] == "live" and table_name in v["tables"]]
                if not live or min(live) >= self.log.end():
                    keep = [c for c in shadow["columns"] if c in types]
                    if all(set(x["by"]) <= set(keep) for x in shadow["layouts"]) and shadow["key"] == table["key"]:
                        self._write_shadow(table_name, keep, [x["by"] for x in shadow["layouts"]], self.log.end())
                    else:  # nothing live uses it; the next build makes it anew
                        self._discard_shadow(table_name)
            return hit

        return self._change(alter)

    def unregister_table(self, name: str, cascade: bool = False) -> None:
        def remove() -> str:
            table = self._table(name)
            users = [v for v, x in self.manifest["views"].items() if table in x["tables"]]
            if users and not cascade:
                raise ViewError(f"views depend on {table}", ", ".join(users), "pass cascade=True to drop them too")
            for v in users:
                self._drop(v)
            del self.manifest["tables"][table]
            return table

        self._change(remove)

    def table_schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest["tables"][self._table(name)]["schema"]))

    def _table(self, name: str) -> str:
        name = canonical(name)
        if name not in self.manifest["tables"]:
            raise NotFound(f"no table {name}")
        return name

    def _show(self, name: str) -> None:
        # Views of an empty frame: definitions are analysed against them, and nothing can be written through them.
        empty = self.session.createDataFrame([], self.table_schema(name))
        empty.select("*").createOrReplaceTempView(view_name(name))

    def _facts(self) -> dict[str, dict]:
        return {n: {"key": t["key"], "columns": {f.name: f.dataType.simpleString() for f in self.table_schema(n)}} for n, t in self.manifest["tables"].items()}

    def _changes(self, table: str, after: int, upto: int) -> DataFrame:
        return self.log.read(table, self.table_schema(table), after, upto)

    def _base(self, table: str, upto: int) -> DataFrame:
        """The table's rows at a position."""
        t = self.manifest["tables"][table]
        rows, changes = self.spark.read.parquet(t["path"]), self._changes(table, t["from"], upto)
        columns = self.table_schema(table).names
        if not any(table in s["paths"] for s in self.log.segments() if s["to"] > t["from"]):
            return rows.select(*columns)
        cut = changes.where("op = 'T'").agg(F.max("lsn").alias("at")).first()["at"]
        if cut is not None:
            rows, changes = rows.limit(0), changes.where(F.col("lsn") > cut)
        if not t["key"]:
            return D.counted(rows, D.plain(changes, columns), columns)
        return D.latest(D.versions(rows, D.net_changes(changes, t["key"], columns), t["key"], columns))

    # Manifest

    def _reload(self) -> None:
        """The newest manifest, which another engine may have written."""
        there = self.store.numbered("manifests")
        if there and there[-1] > self.manifest["version"]:
            self.manifest = self.store.read(_manifest(there[-1])) or self.manifest
        now = {n: t["schema"] for n, t in self.manifest["tables"].items()}
        for name in set(self._shown) - set(now):
            self.session.catalog.dropTempView(view_name(name))
        for name in [n for n, x in now.items() if self._shown.get(n) != x]:
            self._show(name)
        self._shown = now

    def _commit(self) -> None:
        """Writes the manifest that follows the one it was read from, or undoes what was made if there is one already."""
        old = self.manifest["version"]
        kept, gone, now = [], [], time.time()
        for x in self.manifest["trash"]:
            (gone if now - x["at"] > self.settings["keep_seconds"] else kept).append(x)
        made, self._made = self._made, []
        if not self.store.create(_manifest(old + 1), self.manifest | {"version": old + 1, "trash": kept}):
            for path in made:
                self.store.remove(path)
            self.manifest = self.manifest | {"version": -1}
            self._reload()
            raise Conflict("another engine changed this folder first")
        self.manifest |= {"version": old + 1, "trash": kept}
        for x in gone:
            self.store.remove(x["path"])
        for n in self.store.numbered("manifests")[:-20]:
            self.store.remove(_manifest(n))
        self._reload()

    def _change(self, f: Callable[[], object]):
        """Makes a change of the newest manifest and commits it, again if another engine came first."""
        for left in range(50, 0, -1):
            self._reload()
            before = json.dumps(self.manifest)
            try:
                out = f()
            except Exception:
                self.manifest = json.loads(before)
                raise
            try:
                self._commit()
                return out
            except Conflict:
                if left == 1:
                    raise
        return None

    def _write(self, df: DataFrame, kind: str) -> str:
        path = self.store.folder(kind)
        df.write.parquet(path)
        return path

    def _put(self, rows: DataFrame, by: list[str], n: int, kind: str) -> dict:
        layout = B.put(self.store, rows, by, n, kind)
        self._made += layout["parts"].values()
        return layout

    def _replace(self, layout: dict, rows: DataFrame, only: set[int] | None, kind: str) -> dict:
        return self._taken(layout, *B.replaced(self.store, layout, rows, only, kind))

    def _taken(self, layout: dict, new: dict, gone: list[str]) -> dict:
        self._made += [p for p in new["parts"].values() if p not in layout["parts"].values()]
        for path in gone:
            self._discard(path)
        return new

    def _discard(self, path: str | None) -> None:
        if path:
            self.manifest["trash"].append({"path": path, "at": time.time()})

    def _discard_layout(self, layout: dict | None) -> None:
        for path in (layout or {"parts": {}})["parts"].values():
            self._discard(path)

    def _buckets(self, tables: list[str]) -> int:
        """Buckets for rows that come from some tables, by the size of the largest."""
        return max(B.number(self._bytes(self.manifest["tables"][t]["path"]), self.settings["bucket_bytes"]) for t in tables)

    def _bytes(self, path: str) -> int:
        at = self.store._path(path)
        return at.getFileSystem(self.store._conf).getContentSummary(at).getLength()

    def _view(self, name: str) -> dict:
        name = canonical(name)
        if name not in self.manifest["views"]:
            raise NotFound(f"no view {name}")
        return self.manifest["views"][name]

    def _stale(self, view: dict, reason: str) -> None:
        if view["status"] != "failed":
            view |= {"status": "stale", "stale_reason": reason}

    # Views

    def create_view(self, name: str, definition: str) -> str:
        """Checks and records the definition; :meth:`run_pending` or the next round builds it."""
        name = canonical(name)

        def add() -> str:
            if name in self.manifest["views"] or name in self.manifest["tables"]:
                raise Exists(f"{name} exists")
            spec = self._validated(definition)
            self.manifest["views"][name] = {
                "id": uuid.uuid4().hex, "name": name, "definition": definition, "spec": spec.to_json(), "status": "initializing", "tables": [r.table for r in spec.relations],
                "frontier": 0, "epoch": 1, "last_seq": 0, "oldest_seq": 1, "failures": 0, "last_error": None, "stale_reason": None, "state": None, "schema": None, "deltas": [],
            }
            return name

        return self._change(add)

    def _validated(self, definition: str) -> ViewSpec:
        try:
            return validate(self.session, definition, self._facts())
        except Unsupported as e:
            if "UNRESOLVED_ROUTINE" not in (e.detail or ""):
                raise
        self._session()  # the caller may have registered a function since
        return validate(self.session, definition, self._facts())

    def drop_view(self, name: str) -> None:
        self._change(lambda: self._drop(name))

    def _drop(self, name: str) -> None:
        view = self._view(name)
        self._discard_layout(view["state"])
        for d in view["deltas"]:
            self._discard(d["path"])
        del self.manifest["views"][view["name"]]
        used = {t for v in self.manifest["views"].values() for t in v["tables"] if len(v["tables"]) > 1}
        for t in [t for t in self.manifest["shadows"] if t not in used]:
            self._discard_shadow(t)

    def closure(self, name: str) -> list[str]:
        """The views that a refresh of this one rebuilds: those it shares shadows with, directly or over others."""
        views, found = self.manifest["views"], [self._view(name)["name"]]
        for v in found:
            if len(views[v]["tables"]) > 1:
                found += [w for w, x in views.items() if w not in found and len(x["tables"]) > 1 and set(x["tables"]) & set(views[v]["tables"])]
        return found

    def refresh(self, name: str) -> list[str]:
        def mark() -> list[str]:
            names = self.closure(name)
            for n in names:
                lost = [t for t in self.manifest["views"][n]["tables"] if t not in self.manifest["tables"]]
                if lost:
                    raise BuildFailed(f"{n} can't be rebuilt", f"table {lost[0]} is gone")
            for n in names:
                self.manifest["views"][n]["status"] = "refreshing"
            return names

        return self._change(mark)

    def run_pending(self) -> int:
        """Builds the views that wait for it, all at one position: the log's end."""
        self._reload()
        if not any(v["status"] in ("initializing", "refreshing") for v in self.manifest["views"].values()):
            return 0
        return self._change(self._build)

    def _build(self) -> int:
        waiting = [v for v in self.manifest["views"].values() if v["status"] in ("initializing", "refreshing")]
        at = self.log.end()
        for v in waiting:
            again = v["status"] == "refreshing"
            try:
                spec = self._validated(v["definition"])
                needs = [self._base(r.table, at).select(*self._columns(r)) for r in spec.relations]
                rows = self._rows_of(spec, needs)
                state = self._put(rows, spec.identity, self._buckets([r.table for r in spec.relations]), "view")
            except Exception as e:  # the error is the view's; others are built
                v |= {"status": "failed", "last_error": getattr(e, "detail", None) or str(e).splitlines()[0][:500]}
                continue
            self._discard_layout(v["state"])
            for d in v["deltas"] if again else []:
                self._discard(d["path"])
            v |= {"spec": spec.to_json(), "state": state, "schema": rows.schema.json(), "status": "live", "frontier": at, "failures": 0, "last_error": None, "stale_reason": None, "deltas": [], "oldest_seq": v["last_seq"] + 1, "epoch": v["epoch"] + again, "populated_at": time.time()}
            if len(spec.relations) > 1:
                for r in spec.relations:
                    self._ensure_shadow(spec, r, at)
        return len(waiting)

    @staticmethod
    def _columns(r) -> list[str]:
        return list(dict.fromkeys([*r.key, *r.used]))

    @staticmethod
    def _join_columns(spec: ViewSpec, alias: str, other: str) -> list[tuple[str, str]]:
        """(column of a relation, column of another that it must equal) by the view's conditions."""
        out = []
        for a, b in spec.join_keys:
            for x, y in ((a, b), (b, a)):
                if x.split(".", 1)[0] == alias and y.split(".", 1)[0] == other:
                    out.append((x.split(".", 1)[1], y.split(".", 1)[1]))
        return sorted(set(out))

    def _ensure_shadow(self, spec: ViewSpec, r, at: int) -> None:
        """A shadow that has the relation's columns and layouts and is not ahead of any live view that joins it."""
        have = self.manifest["shadows"].get(r.table)
        columns, layouts = self._columns(r), [r.key]
        for other in spec.relations:
            own = [a for a, _ in self._join_columns(spec, r.alias, other.alias)]
            if own and own not in layouts:
                layouts.append(own)
        if have and set(columns) <= set(have["columns"]) and all(x in [h["by"] for h in have["layouts"]] for x in layouts):
            return
        at = min([at, *(v["frontier"] for v in self.manifest["views"].values() if v["status"] == "live" and r.table in v["tables"] and len(v["tables"]) > 1)])
        names = list(dict.fromkeys([*(have["columns"] if have else []), *columns]))
        for h in have["layouts"] if have else []:
            if h["by"] not in layouts:
                layouts.append(h["by"])
        self._write_shadow(r.table, names, layouts, at)

    def _write_shadow(self, table: str, columns: list[str], layouts: list[list[str]], at: int) -> None:
        self._discard_shadow(table)
        key = self.manifest["tables"][table]["key"]
        rows, n = self._base(table, at).select(*dict.fromkeys([*key, *columns])), self._buckets([table])
        made = [self._put(rows, by, n, "shadow") for by in (layouts if n > 1 else layouts[:1])]
        # A table of one bucket is read as a whole: one layout serves for all.
        made += [made[0] | {"by": by} for by in layouts[len(made) :]]
        self.manifest["shadows"][table] = {"layouts": made, "schema": rows.schema.json(), "frontier": at, "columns": columns, "key": key}

    def _discard_shadow(self, table: str) -> None:
        for layout in (self.manifest["shadows"].pop(table, None) or {"layouts": []})["layouts"]:
            self._discard_layout(layout)

    def _state(self, v: dict, only: set[int] | None = None) -> DataFrame:
        return B.get(self.spark, v["state"], T.StructType.fromJson(json.loads(v["schema"])), only)

    def _shadow(self, table: str, layout: dict, only: set[int] | None = None) -> DataFrame:
        return B.get(self.spark, layout, T.StructType.fromJson(json.loads(self.manifest["shadows"][table]["schema"])), only)

    # The defining query as rows of state

    @staticmethod
    def _state_columns(spec: ViewSpec) -> list[str]:
        return [*spec.visible, *(n for n, _ in spec.hidden)]

    def _rows_of(self, spec: ViewSpec, tables: list[DataFrame]) -> DataFrame:
        rows = tables[0].alias(spec.relations[0].alias)
        for r, t in zip(spec.relations[1:], tables[1:], strict=True):
            rows = rows.crossJoin(t.alias(r.alias))
        for q in spec.quals:
            rows = rows.where(F.expr(q))
        if spec.shape == "projection":
            return rows.select(*[F.expr(i.sql).alias(i.name) for i in spec.items], *[F.expr(s).alias(n) for n, s in spec.hidden])
        keys = [F.expr(i.sql).alias(i.name) for i in spec.keys]
        makers = {"count": lambda i: F.count(F.lit(1)), "count_of": lambda i: F.count(F.expr(i.sql)), "sum": lambda i: F.sum(F.expr(i.sql))}
        aggregates = [makers[i.kind](i).alias(i.name) for i in spec.items if i.kind != "key"]
        return rows.groupBy(*keys).agg(*aggregates, *[F.count(F.expr(s)).alias(n) for n, s in spec.hidden]).select(*self._state_columns(spec))

    # Rounds

    def run_round(self) -> bool:
        """Builds what waits and applies one batch of the log. False if there was nothing to do, in which case nothing is
        written. If another engine commits meanwhile, the round is undone, to be run again on what is then there."""
        did = self.run_pending() > 0
        self._reload()
        live = [v for v in self.manifest["views"].values() if v["status"] == "live"]
        end = self.log.end()
        if not live:
            return did
        start = min(v["frontier"] for v in live)
        if start >= end:
            return did
        before = json.dumps(self.manifest)
        try:
            told = self._round(live, start)
            self._commit()
        except Conflict:
            return True
        except Exception:
            self.manifest = json.loads(before)
            raise
        for name, seq, lsn in told:
            for f in self.listeners:
                f(name, seq, lsn)
        return True

    def _round(self, live: list[dict], start: int) -> list[tuple[str, int, int]]:
        if self.log.pending(start) > self.settings["max_pending_changes"]:
            for v in live:
                self._stale(v, f"the log is {self.log.pending(start)} changes ahead")
            return []
        upto = self.log.upto(start, self.settings["batch_changes"])
        self._truncations(live, start, upto)
        behind = [v for v in live if v["status"] == "live" and v["frontier"] < upto]
        before = [v["last_seq"] for v in behind]
        with ThreadPoolExecutor(self.settings["views_at_once"]) as pool:  # each has jobs and manifest entries of its own
            list(pool.map(lambda v: self._advance(v, upto), behind))
        self._move_shadows()
        self.manifest["offset"] = upto
        self._retain()
        return [(v["name"], v["last_seq"], v["frontier"]) for v, b in zip(behind, before, strict=True) if v["last_seq"] > b]

    def _retain(self) -> None:
        """Tables with very many changes since their base get a new one; segments that nothing reads any more go."""
        segments = self.log.segments()
        for name, t in self.manifest["tables"].items():
            if sum(s.get("counts", {}).get(name, 0) for s in segments if s["to"] > t["from"]) > self.settings["compact_changes"]:
                self._compact(name)
            elif not any(name in s["paths"] for s in segments if s["to"] > t["from"]):
                t["from"] = max(t["from"], segments[-1]["to"] if segments else 0)
        views = [v["frontier"] for v in self.manifest["views"].values() if v["status"] == "live"]
        needed = min([*(t["from"] for t in self.manifest["tables"].values()), *(s["frontier"] for s in self.manifest["shadows"].values()), *views], default=0)
        if needed > min([s["to"] for s in segments[:-1]], default=needed):
            # Not before the manifest that no longer needs them has been kept as long as readers may use it.
            self.manifest.setdefault("trims", []).append({"upto": needed, "at": time.time()})
        ready = [x for x in self.manifest.get("trims", []) if time.time() - x["at"] > self.settings["keep_seconds"]]
        if ready:
            self.manifest["trims"] = [x for x in self.manifest["trims"] if x not in ready]
            self.log.trim(max(x["upto"] for x in ready))

    def _compact(self, name: str, to: int | None = None) -> None:
        t = self.manifest["tables"][name]
        to = self.manifest["offset"] if to is None else to
        if to > t["from"]:
            path = self._write(self._base(name, to), "base")
            self._made.append(path)
            if t["path"].startswith(f"{self.root}/"):
                self._discard(t["path"])
            t |= {"path": path, "from": to}

    def drain(self, most: int = 1000) -> int:
        n = 0
        while n < most and self.run_round():
            n += 1
        return n

    def run(self, until: Callable[[], bool]) -> None:
        """Rounds without pause while there is work, else one each ``poll_interval_ms``, until told to stop."""
        while not until():
            if not self.run_round():
                time.sleep(self.settings["poll_interval_ms"] / 1000)

    def _truncations(self, live: list[dict], start: int, upto: int) -> None:
        """Views of tables that were truncated, or whose updates lack values that can't be had, become stale."""
        for table in sorted({t for v in live for t in v["tables"]}):
            if not any(table in s["paths"] for s in self.log.segments() if s["to"] > start and s["from"] <= upto):
                continue
            changes = self._changes(table, start, upto)
            lost = F.when((F.col("op") == "U") & F.col("before").isNull(), F.coalesce("unchanged", F.array().cast("array<string>")))
            found = changes.agg(F.max(F.when(F.col("op") == "T", F.col("lsn"))).alias("cut"), F.array_distinct(F.flatten(F.collect_set(lost))).alias("lost"), F.max(F.when(F.col("op").isin("U", "D") & F.col("before").isNull(), F.col("lsn"))).alias("blind")).first()
            for v in live:
                if table not in v["tables"]:
                    continue
                used = {c for r in v["spec"]["relations"] if r["table"] == table for c in r["used"]}
                if found["cut"] is not None and found["cut"] > v["frontier"]:
                    self._stale(v, f"{table} was truncated; refresh the view")
                elif set(found["lost"] or []) & used or (found["blind"] or 0) > v["frontier"]:
                    self._stale(v, f"an old row of {table} is not available; refresh the view")

    def _advance(self, v: dict, upto: int) -> None:
        """Brings a view to a position, or as near as its errors let it: the longest run of transactions that can be
        applied, found by halving."""
        spec = ViewSpec.from_json(v["spec"])
        try:
            self._apply(v, spec, upto)
            v |= {"failures": 0, "last_error": None}
            return
        except Exception as e:
            error = e
        # Positions alone, of one batch, which ``batch_changes`` bounds; the trial rounds compute, but write nothing.
        marks = sorted({r["lsn"] for t in v["tables"] for r in self._changes(t, v["frontier"], upto).select("lsn").distinct().collect()})
        low, high = 0, len(marks) - 1  # the answer is a number of good transactions in [low, high]
        while low < high:
            mid = (low + high + 1) // 2
            try:
                self._apply(v, spec, marks[mid - 1], keep=False)
                low = mid
            except Exception as e:
                error, high = e, mid - 1
        if low:
            self._apply(v, spec, marks[low - 1])
        v["failures"] += 1
        v["last_error"], v["last_error_at"] = str(error).splitlines()[0][:500], time.time()
        if v["failures"] >= self.settings["max_apply_failures"]:
            self._stale(v, f"apply failed {v['failures']} times: {v['last_error']}")

    def _apply(self, v: dict, spec: ViewSpec, upto: int, keep: bool = True) -> None:
        """Brings a view to a position; without ``keep`` the changes are only computed, to see whether that fails."""
        net = self.net(v, spec, upto)
        if not keep:
            if net is not None:
                net.write.format("noop").mode("overwrite").save()
            return
        if net is not None:
            path = self._write(net, "net")  # computed once, for the feed and for the state
            self._made.append(path)
            net = self.spark.read.schema(net.schema).parquet(path)
            self._discard(path)
            only = B.touched(v["state"], net.select(*spec.identity))
            columns, last = self._state_columns(spec), v["last_seq"]
            with ThreadPoolExecutor(2) as pool:
                state = pool.submit(B.replaced, self.store, v["state"], D.merged(self._state(v, only), net, spec.identity, columns), only, "view")
                deltas = self._write_feed(net, spec, last)
                v["state"] = self._taken(v["state"], *state.result())
            self._made.append(deltas)
            rows = self.spark.read.parquet(deltas).count()
            if rows:
                v["deltas"].append({"path": deltas, "from": last + 1, "to": last + rows})
                v["last_seq"] = last + rows
            else:
                self._discard(deltas)
        v["frontier"] = upto
        v["oldest_seq"] = max(v["oldest_seq"], v["last_seq"] - self.settings["retain_deltas"] + 1)
        for d in [d for d in v["deltas"] if d["to"] < v["oldest_seq"]]:
            self._discard(d["path"])
            v["deltas"].remove(d)

    def _write_feed(self, net: DataFrame, spec: ViewSpec, last: int) -> str:
        """The folder of the net changes' feed. A batch of many rows is sorted in ranges, which are written and then
        numbered by their counts; few rows are numbered at once."""
        if net.count() <= ALONE:
            return self._write(D.feed(net, spec.identity, spec.visible, last), "deltas")
        path = self._write(D.feed_parts(net, spec.identity, spec.visible), "deltas")
        self._made.append(path)
        self._discard(path)
        parts = self.spark.read.parquet(path)
        counts = sorted((r["part"], r["count"]) for r in parts.groupBy("part").count().collect())  # a row a task
        starts, at = [], last
        for part, n in counts:
            starts.append((part, at))
            at += n
        offsets = F.broadcast(self.spark.createDataFrame(starts, "part int, start long"))
        return self._write(parts.join(offsets, "part").select((F.col("start") + F.col("place") + 1).alias("seq"), "lsn", "xid", "op", "row"), "deltas")

    def _histories(self, v: dict, spec: ViewSpec, upto: int) -> tuple[list[DataFrame | None], Callable[[int, int], DataFrame]]:
        """(signed changes of each relation of a view since its position, the versions of relation j that the changes of
        relation i can meet). Of j's shadow only the buckets with the join keys of i's changes are read, where it is
        laid out by the columns that the view joins them on; else all of it. A single table needs no versions."""
        changed: list[DataFrame | None] = []
        nets: list[DataFrame | None] = []
        segments = self.log.segments()
        for r in spec.relations:
            columns = self._columns(r)
            shadow = self.manifest["shadows"].get(r.table)
            since = shadow["frontier"] if shadow and len(spec.relations) > 1 else v["frontier"]
            some = any(r.table in s["paths"] for s in segments if s["to"] > since and s["from"] <= upto)
            nets.append(D.net_changes(self._changes(r.table, since, upto), r.key or columns, columns) if some else None)
            fresh = any(r.table in s["paths"] for s in segments if s["to"] > v["frontier"] and s["from"] <= upto)
            changed.append(D.signed(nets[-1].where(F.col("lsn") > v["frontier"]), columns) if some and fresh else None)

        def history(i: int, j: int) -> DataFrame:
            r, columns = spec.relations[j], self._columns(spec.relations[j])
            pairs = self._join_columns(spec, r.alias, spec.relations[i].alias)
            layouts = self.manifest["shadows"][r.table]["layouts"]
            layout = next((x for x in layouts if pairs and x["by"] == [a for a, _ in pairs]), layouts[0])
            by_join = bool(pairs) and layout["by"] == [a for a, _ in pairs]
            kinds = self.table_schema(r.table)
            only = B.touched(layout, changed[i].select(*[F.col(b).cast(kinds[a].dataType).alias(a) for a, b in pairs])) if by_join else None
            base = self._shadow(r.table, layout, only).select(*columns)
            if nets[j] is None:
                return base.select("*", F.lit(D.FIRST).cast("long").alias("__from"), F.lit(D.LAST).alias("__to"))
            return D.versions(base, nets[j], r.key, columns)

        return changed, history

    def net(self, v: dict, spec: ViewSpec, upto: int) -> DataFrame | None:
        """(lsn, xid, ord, identity.., before, after) of the view's rows since its position."""
        changed, history = self._histories(v, spec, upto)
        if len(spec.relations) == 1 and not spec.relations[0].key and changed[0] is not None:
            r = spec.relations[0]  # without a key the changes themselves are the signed rows
            changed = [D.plain(self._changes(r.table, v["frontier"], upto), r.used)]
        parts = D.delta_join([r.alias for r in spec.relations], changed, history, spec.quals)
        if parts is None:
            return None
        meta = ["__lsn", "__xid", "__ord", "__w"]
        columns = self._state_columns(spec)
        if spec.shape == "projection":
            made = [rows.select(*meta, *[F.expr(i.sql).alias(i.name) for i in spec.items], *[F.expr(s).alias(n) for n, s in spec.hidden]) for _, rows in parts]
            rows = made[0]
            for m in made[1:]:
                rows = rows.unionByName(m)
            return D.net_projection(rows, spec.identity, columns)
        counters = {"__n": F.lit(1)}
        for i in spec.items:
            if i.kind == "count_of":
                counters[f"__c_{i.name}"] = F.when(F.expr(i.sql).isNotNull(), 1).otherwise(0)
            elif i.kind == "sum":
                counters[f"__c_{i.name}"] = F.when(F.expr(i.sql).isNotNull(), 1).otherwise(0)
                value = F.expr(i.sql)
                counters[f"__s_{i.name}"] = F.coalesce(value, value * 0, F.lit(0)).cast(i.dtype)
        keys = [i.name for i in spec.keys]
        made = [rows.select(*meta, *[F.expr(i.sql).alias(i.name) for i in spec.keys], *[c.alias(n) for n, c in counters.items()]) for _, rows in parts]
        rows = made[0]
        for m in made[1:]:
            rows = rows.unionByName(m)
        kinds = {f"__s_{i.name}": i.dtype for i in spec.items if i.kind == "sum"}
        signed = lambda c: F.sum(F.col(c) * F.col("__w")).cast(kinds.get(c, "long"))
        moves = rows.groupBy(F.col("__lsn").alias("lsn"), F.col("__xid").alias("xid"), *keys).agg(*[signed(c).alias(c) for c in counters], F.min("__ord").alias("ord"))
        if v["state"]["n"] > 1:  # written once, to see which buckets of the state it touches
            path = self._write(moves, "moves")
            self._made.append(path)
            moves = self.spark.read.schema(moves.schema).parquet(path)
            self._discard(path)
        state = self._state(v, B.touched(v["state"], moves.select(*keys)))
        hidden = dict(spec.hidden)
        aggregates = [i for i in spec.items if i.kind != "key"]
        nn = {i.name: f"{D.PREFIX}nn_{n}" for n, i in enumerate(aggregates) if i.kind == "sum"}
        total = next((i.name for i in aggregates if i.kind == "count"), f"{D.PREFIX}n")
        prior: dict[str, Column] = {"__n": F.col(total)}
        held: dict[str, Callable] = {k: lambda of, k=k: F.col(k) for k in keys}
        for i in aggregates:
            if i.kind == "count":
                held[i.name] = lambda of: of("__n")
            elif i.kind == "count_of":
                prior[f"__c_{i.name}"] = F.col(i.name)
                held[i.name] = lambda of, i=i: of(f"__c_{i.name}")
            else:
                prior[f"__c_{i.name}"] = F.col(nn[i.name])
                prior[f"__s_{i.name}"] = F.coalesce(F.col(i.name), F.lit(0)).cast(i.dtype)
                held[i.name] = lambda of, i=i: F.when(of(f"__c_{i.name}") > 0, of(f"__s_{i.name}").cast(i.dtype))
        for n in hidden:
            source = "__n" if n == f"{D.PREFIX}n" else next(f"__c_{i}" for i, h in nn.items() if h == n)
            held[n] = lambda of, source=source: of(source)
        parts = min(PARTS, upto - v["frontier"])
        return D.fold_groups(moves, state.select(*keys, *[c.alias(n) for n, c in prior.items()]), keys, list(counters), lambda of: {c: held[c](of) for c in columns}, v["frontier"], upto, parts)

    def _move_shadows(self) -> None:
        """Shadows follow the least position of the live views that join them; of each layout the buckets that have old or
        new rows of the changed keys are written anew."""
        for table, s in self.manifest["shadows"].items():
            users = [v["frontier"] for v in self.manifest["views"].values() if v["status"] == "live" and table in v["tables"] and len(v["tables"]) > 1]
            if not users or min(users) <= s["frontier"]:
                continue
            to = min(users)
            if any(table in x["paths"] for x in self.log.segments() if x["to"] > s["frontier"] and x["from"] <= to):
                net = D.net_changes(self._changes(table, s["frontier"], to), s["key"], s["columns"])
                names = list(dict.fromkeys([*s["key"], *s["columns"]]))
                made: list[dict] = []
                for layout in s["layouts"]:
                    if made and layout["n"] == 1:
                        made.append(made[0] | {"by": layout["by"]})
                        continue
                    sides = [net.where(f"{side} is not null").select(*[F.col(f"{side}.{c}").alias(c) for c in layout["by"]]) for side in ("before", "after")]
                    only = B.touched(layout, *sides)
                    now = D.latest(D.versions(self._shadow(table, layout, only), net, s["key"], names))
                    made.append(self._replace(layout, now, only, "shadow"))
                s["layouts"] = made
            s["frontier"] = to

    # Readers

    def read(self, name: str) -> DataFrame:
        """The view's visible rows, as of now: the frame's files stay for ``keep_seconds`` after they were replaced. It
        selects from files, so writing through it fails."""
        self._reload()
        view = self._view(name)
        if not view["state"]:
            raise BuildFailed(f"{view['name']} is not built", view["last_error"])
        return self._state(view).select(*ViewSpec.from_json(view["spec"]).visible)

    def storage(self, name: str) -> DataFrame | None:
        """Visible and hidden columns; None until built."""
        self._reload()
        view = self._view(name)
        return self._state(view).select("*") if view["state"] else None

    def publish(self, name: str) -> str:
        """Makes the view readable by SQL as a temporary view of its name; it can't be written through."""
        view = self._view(name)
        self.read(name).createOrReplaceTempView(view_name(view["name"]))
        return view_name(view["name"])

    def insert_into(self, name: str, *_) -> None:
        raise DirectWrite(f"{self._view(name)['name']} is kept by the engine", hint="change the base tables")

    def sql(self, text: str) -> DataFrame:
        """A statement over published views. One that writes to a view (INSERT, MERGE, UPDATE, DELETE, TRUNCATE, DROP, ..) is
        refused before it runs; writes that go past this method meet a frame of files, which Spark itself refuses."""
        self._reload()
        names = {view_name(v).lower(): v for v in self.manifest["views"]}
        for target in targets(self.spark, text):
            if target.lower() in names:
                raise DirectWrite(f"{names[target.lower()]} is kept by the engine", text.split()[0].upper(), "change the base tables")
        return self.spark.sql(text)

    def snapshot(self, name: str, hidden: bool = False) -> tuple[dict, DataFrame | None]:
        """(status, rows) from one manifest; no rows unless the view is live."""
        self._reload()
        v, now = self._view(name), self._status(self._view(name))
        if v["status"] != "live":
            return now, None
        return now, self._state(v).select(*(self._state_columns if hidden else lambda x: x.visible)(ViewSpec.from_json(v["spec"])))

    def frontier(self, name: str) -> int:
        return self._view(name)["frontier"]

    def visible_columns(self, name: str) -> list[str]:
        return ViewSpec.from_json(self._view(name)["spec"]).visible

    def current_seq(self, name: str) -> int:
        return self._view(name)["last_seq"]

    def status(self, name: str) -> dict:
        self._reload()
        return self._status(self._view(name))

    @staticmethod
    def _status(v: dict) -> dict:
        return {"name": v["name"], "status": v["status"], "epoch": v["epoch"], "frontier_lsn": v["frontier"], "frontier": format_position(v["frontier"]), "current_seq": v["last_seq"], "stale_reason": v["last_error"] if v["status"] == "failed" else v["stale_reason"]}

    def _usable(self, v: dict) -> None:
        if v["status"] == "stale":
            raise Stale(f"{v['name']} is stale", v["stale_reason"], "refresh it")
        if v["status"] == "failed":
            raise BuildFailed(f"{v['name']} could not be built", v["last_error"])

    def await_ready(self, name: str, timeout_ms: int = 60_000) -> bool:
        end = time.monotonic() + timeout_ms / 1000
        while True:
            v = self._view(name)
            self._usable(v)
            if v["status"] == "live":
                return True
            if time.monotonic() >= end:
                return False
            self.run_pending()

    def wait_for(self, name: str, lsn: int | str, timeout_ms: int = 5000) -> bool:
        """True once the view and its feed include the position."""
        lsn, end = parse_position(lsn), time.monotonic() + timeout_ms / 1000
        while True:
            v = self._view(name)
            self._usable(v)
            if v["status"] == "live" and v["frontier"] >= lsn:
                return True
            if time.monotonic() >= end or not self.run_round():
                return self._view(name)["status"] == "live" and self._view(name)["frontier"] >= lsn

    def changes(self, name: str, after_seq: int, epoch: int, max_rows: int = 1000, include_hidden: bool = False) -> DataFrame:
        """(seq, lsn, xid, op, row) after a cursor: about ``max_rows`` rows, whole transactions, in order. ``row`` is a
        struct of the visible columns, or of all with ``include_hidden`` (a change of hidden columns alone has no row)."""
        self._reload()
        v = self._view(name)
        self._usable(v)
        if epoch != v["epoch"]:
            raise EpochChanged(f"{v['name']} was rebuilt", f"epoch {epoch} -> {v['epoch']}")
        if after_seq < v["oldest_seq"] - 1:
            raise Lagged(f"changes of {v['name']} after {after_seq} are gone", f"oldest retained seq is {v['oldest_seq']}")
        paths = [d["path"] for d in v["deltas"] if d["to"] > after_seq]
        spec = ViewSpec.from_json(v["spec"])
        names = self._state_columns(spec) if include_hidden else spec.visible
        row = F.struct(*[F.col(f"row.{c}").alias(c) for c in names]).alias("row")
        if not paths:
            kind = self._state(v).select(F.struct(*names).alias("row")).schema["row"]
            schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("lsn", T.LongType()), T.StructField("xid", T.LongType()), T.StructField("op", T.StringType()), kind])
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.parquet(*paths).where(F.col("seq") > after_seq)
        last = rows.where(F.col("seq") <= after_seq + max(1, max_rows)).agg(F.max("lsn").alias("lsn")).first()["lsn"]
        return rows.where(F.col("lsn") <= last).select("seq", "lsn", "xid", "op", row).orderBy("seq")


def compact(engine: Engine, table: str) -> None:
    """Moves a table's base to the least position that any view still needs, so later builds replay less of the log."""

    def move() -> None:
        name = engine._table(table)
        engine._compact(name, min([engine.log.end(), *(s["frontier"] for n, s in engine.manifest["shadows"].items() if n == name)]))

    engine._change(move)


def _manifest(number: int) -> str:
    return f"manifests/{number:012d}.json"


__all__ = ["SETTINGS", "Engine", "compact"]
