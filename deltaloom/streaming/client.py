"""Following a view: a snapshot, then every transaction's changes, and what to do when the thread is lost."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from ..errors import BuildFailed, EpochChanged, Lagged, Stale
from ..functions.names import format_position
from .engine import Engine


@dataclass
class Snapshot:
    """The view at ``cursor``. ``rows`` is a frame over files that later rounds don't touch, and that stay for the engine's
    ``keep_seconds`` after they were replaced."""

    epoch: int
    frontier: int
    cursor: int
    rows: DataFrame


@dataclass
class Transaction:
    xid: int
    lsn: int
    epoch: int
    deltas: list[Row] = field(default_factory=list)


@dataclass
class Resync:
    """Drop what is held; a snapshot follows. ``reason``: lagged, stale or epoch changed."""

    reason: str
    detail: str | None = None


class ProtocolError(Exception):
    """The feed has a gap."""


class Subscription:
    """Iterates over events. :meth:`poll` gives what there is now; iterating waits for more."""

    def __init__(self, engine: Engine, view: str, batch: int = 1000, poll_s: float = 1.0, keep_hidden: bool = False, max_backoff_s: float = 30.0, build_poll_s: float = 0.2):
        self.engine, self.view = engine, engine._view(view)["name"]
        self.batch, self.poll_s, self.keep_hidden, self.max_backoff_s, self.build_poll_s = batch, poll_s, keep_hidden, max_backoff_s, build_poll_s
        self.cursor: int | None = None
        self.epoch: int | None = None
        self._woken = False
        engine.listeners.append(self._wake)

    def _wake(self, name: str, seq: int, lsn: int) -> None:
        self._woken |= name == self.view

    def close(self) -> None:
        self.engine.listeners.remove(self._wake)

    def _snapshot(self) -> Snapshot | None:
        """All from one manifest; None while the view is being built or is stale."""
        now, rows = self.engine.snapshot(self.view, self.keep_hidden)
        if now["status"] == "failed":
            raise BuildFailed(f"{self.view} could not be built", now["stale_reason"])
        if rows is None:
            return None
        return Snapshot(now["epoch"], now["frontier_lsn"], now["current_seq"], rows)

    def poll(self) -> Iterator[Snapshot | Transaction | Resync]:
        """Events until nothing more is there. The cursor moves when an event is handed out."""
        if self.cursor is None:
            first = self._snapshot()
            if first is None:
                return
            self.cursor, self.epoch = first.cursor, first.epoch
            yield first
        while True:
            try:
                rows = self.engine.changes(self.view, self.cursor, self.epoch, self.batch, self.keep_hidden).collect()  # a batch and its last transaction
            except (Lagged, Stale, EpochChanged) as e:
                self.cursor = self.epoch = None
                yield Resync({"IV001": "lagged", "IV002": "stale", "IV003": "epoch changed"}[e.code], e.detail)
                return
            self._woken = False
            made: list[Transaction] = []
            for n, row in enumerate(rows, 1):
                if row["seq"] != self.cursor + n:
                    raise ProtocolError(f"change {self.cursor + n} is missing, {row['seq']} came")
                if not made or (made[-1].xid, made[-1].lsn) != (row["xid"], row["lsn"]):
                    made.append(Transaction(row["xid"], row["lsn"], self.epoch))
                made[-1].deltas.append(row)
            for t in made:
                self.cursor = t.deltas[-1]["seq"]
                yield t
            if len(rows) < self.batch:
                return

    def __iter__(self) -> Iterator[Snapshot | Transaction | Resync]:
        wait = self.build_poll_s
        while True:
            any_event = False
            for event in self.poll():
                any_event = True
                yield event
            wait = self.build_poll_s if any_event else min(wait * 2, self.max_backoff_s if self.cursor is None else self.poll_s)
            if not self._woken:
                time.sleep(wait)

    def wait_for(self, lsn: int | str, timeout_ms: int = 5000) -> bool:
        return self.engine.wait_for(self.view, lsn, timeout_ms)


def lines(event: Snapshot | Transaction | Resync) -> list[str]:
    """An event as the ``follow`` command prints it."""
    if isinstance(event, Snapshot):
        return [f"snapshot epoch={event.epoch} frontier={format_position(event.frontier)} cursor={event.cursor}"]
    if isinstance(event, Transaction):
        head = f"tx lsn={format_position(event.lsn)} xid={event.xid} deltas={len(event.deltas)}"
        return [head, *(f"  {d['op']} {d['row'].asDict(recursive=True)}" for d in event.deltas)]
    return [f"resync: {event.reason}" + (f" ({event.detail})" if event.detail else "")]


def follow(engine: Engine, view: str, rounds: int | None = None) -> Iterator[str]:
    """The ``follow`` command: applies rounds and gives the lines of what happens."""
    subscription, n = Subscription(engine, view), 0
    try:
        while rounds is None or n < rounds:
            engine.run_round()
            for event in subscription.poll():
                yield from lines(event)
            n += 1
    finally:
        subscription.close()


def main() -> None:
    import argparse

    from pyspark.sql import SparkSession

    arguments = argparse.ArgumentParser(description="Follows a view of an engine's folder.")
    arguments.add_argument("root")
    arguments.add_argument("view")
    a = arguments.parse_args()
    for line in follow(Engine(SparkSession.builder.getOrCreate(), a.root), a.view):
        print(line, flush=True)


if __name__ == "__main__":
    main()
