"""Delta algebra on DataFrames: signed rows, versioned tables, delta joins, state merges and netting.

A table's history over a batch of transactions is a set of versions: its columns with the positions [__from, __to) in
which they held. The delta of an inner join is telescoped: the change of relation i is joined with the other relations
as they were after its transaction (those before i) or before it (those after i). One job does so for all transactions of
a batch; there is no loop over changes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, LAST = -1, (1 << 63) - 1
PREFIX = "__ivm_"
#: Copies of a row that are made of one row at once.
COPIES = 4096


def _sent(names: Sequence[str]) -> Column:
    """A change's row after, with the values that weren't sent taken from before."""
    unchanged = F.coalesce("unchanged", F.array().cast("array<string>"))
    return F.struct(*[F.when(F.array_contains(unchanged, c), F.col(f"before.{c}")).otherwise(F.col(f"after.{c}")).alias(c) for c in names])


def net_changes(changes: DataFrame, key: Sequence[str], used: Sequence[str]) -> DataFrame:
    """(lsn, xid, ord, key.., before, after) for each key that a transaction changed, its steps in between left out. An
    update that changes the key is a delete and an insert. Values that weren't sent are taken from before. Keys whose
    used columns are as before are left out."""
    names = [*dict.fromkeys([*key, *used])]
    sent = _sent(names)
    old = F.struct(*[F.col(f"before.{c}").alias(c) for c in names])
    step = lambda sign, row: F.struct(F.lit(sign).alias("w"), row.alias("r"))
    steps = F.when(F.col("op") == "I", F.array(step(1, sent))).when(F.col("op") == "D", F.array(step(-1, old))).otherwise(F.array(step(-1, old), step(1, sent)))
    rows = changes.where("op <> 'T'").select("lsn", "xid", "ord", F.posexplode(steps).alias("half", "s")).select("lsn", "xid", "ord", (F.col("ord").cast("long") * 2 + F.col("half")).alias("at"), "s", *[F.col(f"s.r.{c}").alias(c) for c in key])
    grouped = rows.groupBy("lsn", "xid", *key).agg(F.min("ord").alias("ord"), F.min_by("s", "at").alias("a"), F.max_by("s", "at").alias("b"))
    before, after = F.when(F.col("a.w") < 0, F.col("a.r")), F.when(F.col("b.w") > 0, F.col("b.r"))
    out = grouped.select("lsn", "xid", "ord", *key, before.alias("before"), after.alias("after"))
    return out.where(~F.col("before").eqNullSafe(F.col("after")))


def signed(net: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns with __lsn, __xid, __ord and __w: -1 for the row before, +1 for that after."""
    both = F.array(F.struct(F.lit(-1).alias("w"), F.col("before").alias("r")), F.struct(F.lit(1).alias("w"), F.col("after").alias("r")))
    rows = net.select(F.col("lsn").alias("__lsn"), F.col("xid").alias("__xid"), F.col("ord").alias("__ord"), F.explode(F.filter(both, lambda x: x["r"].isNotNull())).alias("s"))
    return rows.select("__lsn", "__xid", "__ord", F.col("s.w").alias("__w"), *[F.col(f"s.r.{c}").alias(c) for c in columns])


def plain(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """:func:`signed` for a table without a key: the rows before and after of the changes themselves."""
    old = F.struct(*[F.col(f"before.{c}").alias(c) for c in columns])
    return signed(changes.withColumns({"before": F.when(F.col("before").isNotNull(), old), "after": F.when(F.col("after").isNotNull(), _sent(columns))}), columns)


def counted(base: DataFrame, moves: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of a table without a key that is ``base`` before the signed rows ``moves``: each value as often as is left
    of it. Copies are made in pieces that are dealt over tasks, however often one value is there."""
    signs = base.select(*columns, F.lit(1).alias("__w")).unionByName(moves.select(*columns, "__w"))
    left = signs.groupBy(*columns).agg(F.sum("__w").alias("__n")).where("__n > 0")
    pieces = left.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))).alias("__at"), "__n").hint("rebalance")
    copies = F.array_repeat(F.lit(0), F.least(F.lit(COPIES), F.col("__n") - F.col("__at")).cast("int"))
    return pieces.select(*columns, F.explode(copies).alias("__copy")).select(*columns)


def versions(base: DataFrame, net: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The history of a table that is ``base`` before the changes ``net``. Rows whose key isn't touched are not shuffled
    by it: the touched keys, a batch at most, are joined to them."""
    touched = net.select(*key).distinct()
    here = base.select(*columns)
    still = here.join(touched, list(key), "left_anti").select(*columns, F.lit(FIRST).cast("long").alias("__from"), F.lit(LAST).alias("__to"))
    events = here.join(touched, list(key), "left_semi").select(*[F.col(c).alias(f"__k_{c}") for c in key], F.lit(FIRST).cast("long").alias("__from"), F.struct(*columns).alias("r"))
    events = events.unionByName(net.select(*[F.col(c).alias(f"__k_{c}") for c in key], F.col("lsn").alias("__from"), F.struct(*[F.col(f"after.{c}").alias(c) for c in columns]).alias("q"), "after").select(*[f"__k_{c}" for c in key], "__from", F.when(F.col("after").isNotNull(), F.col("q")).alias("r")))
    until = F.lead("__from").over(Window.partitionBy(*[f"__k_{c}" for c in key]).orderBy("__from"))
    events = events.withColumn("__to", F.coalesce(until, F.lit(LAST))).where("r is not null")
    return still.unionByName(events.select(*[F.col(f"r.{c}").alias(c) for c in columns], "__from", "__to"))


def latest(history: DataFrame) -> DataFrame:
    return history.where(F.col("__to") == LAST).drop("__from", "__to")


def delta_join(aliases: Sequence[str], changed: Sequence[DataFrame | None], history: Callable[[int, int], DataFrame], quals: Sequence[str]) -> list[tuple[int, DataFrame]] | None:
    """The signed rows of the join, in parts by the relation that changed, with the relations' columns under their aliases
    and __lsn, __xid, __ord, __w. ``history(i, j)``: the versions of relation j that changes of i are joined with. None if
    no relation changed (``changed`` has None there)."""
    parts = []
    for i, delta in enumerate(changed):
        if delta is None:
            continue
        rows = delta.alias(aliases[i])
        on: list[Column] = []
        for j in range(len(aliases)):
            if j == i:
                continue
            own = history(i, j).withColumnsRenamed({"__from": f"__from{j}", "__to": f"__to{j}"}).alias(aliases[j])
            t = F.col("__lsn")
            on.append((F.col(f"__from{j}") <= t) & (t < F.col(f"__to{j}")) if j < i else (F.col(f"__from{j}") < t) & (t <= F.col(f"__to{j}")))
            rows = rows.crossJoin(own)  # the conditions below make it an equi-join where there is a join key
        for q in quals:
            rows = rows.where(F.expr(q))
        for c in on:
            rows = rows.where(c)
        parts.append((i, rows))
    return parts or None


def net_projection(rows: DataFrame, identity: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(lsn, xid, ord, identity.., before, after) from signed view rows: rows that cancel out within a transaction go."""
    kept = rows.groupBy("__lsn", "__xid", *columns).agg(F.sum("__w").alias("w"), F.min("__ord").alias("o")).where("w <> 0")
    row = F.struct(*columns)
    return kept.groupBy(F.col("__lsn").alias("lsn"), F.col("__xid").alias("xid"), *identity).agg(F.min("o").alias("ord"), F.max(F.when(F.col("w") < 0, row)).alias("before"), F.max(F.when(F.col("w") > 0, row)).alias("after"))


def fold_groups(contributions: DataFrame, state: DataFrame, keys: Sequence[str], counters: Sequence[str], finish: Callable[[Callable[[str], Column]], dict[str, Column]], low: int, high: int, parts: int = 1) -> DataFrame:
    """(lsn, xid, ord, keys.., before, after) of aggregate groups. ``contributions``: for each transaction in (low, high] and
    group the signed changes of ``counters`` (the first is the group's rows); ``state``: the counters before the batch;
    ``finish`` makes a row of the counters that it is given by name. Running sums give every group as of every
    transaction; a group without rows does not exist. Only touched groups of the state are read. With several ``parts``
    the positions are cut into as many stretches, whose sums are carried forward, so a view of few groups is more tasks
    than groups."""
    at = F.floor((F.col("lsn") - (low + 1)) / (high - low) * parts).cast("int") if parts > 1 else F.lit(0)
    moves = contributions.withColumn("__part", at)
    if parts > 1:
        earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        sums = moves.groupBy(*keys, "__part").agg(*[F.sum(c).alias(c) for c in counters])
        sums = sums.select(*keys, "__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in counters])
    else:
        sums = moves.select(*keys, "__part", *[F.lit(0).alias(c) for c in counters]).distinct()
    # Keys under other names on one side, as nulls are keys too and are compared as such.
    prior = state.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__p_{c}") for c in counters])
    base = sums.join(prior, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "left")
    base = base.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__k_part"), *[(F.coalesce(f"__p_{c}", F.lit(0)) + F.col(c)).alias(f"__b_{c}") for c in counters])
    moves = moves.join(base, [*[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__part") == F.col("__k_part")])
    run, kinds = Window.partitionBy(*keys, "__part").orderBy("lsn"), {f.name: f.dataType for f in prior.schema}
    frames = {"before": run.rowsBetween(Window.unboundedPreceding, -1), "after": run.rowsBetween(Window.unboundedPreceding, Window.currentRow)}
    moves = moves.withColumns({f"__{name}_{c}": (F.col(f"__b_{c}") + F.coalesce(F.sum(c).over(frame), F.lit(0))).cast(kinds[f"__p_{c}"]) for name, frame in frames.items() for c in counters})
    rows = []
    for name in frames:
        made = finish(lambda c, n=name: F.col(f"__{n}_{c}"))
        rows.append(F.when(F.col(f"__{name}_{counters[0]}") > 0, F.struct(*[c.alias(n) for n, c in made.items()])).alias(name))
    return moves.select("lsn", "xid", "ord", *keys, *rows)


def feed_rows(net: DataFrame, identity: Sequence[str], visible: Sequence[str]) -> DataFrame:
    """(lsn, xid, ord, id, op, row) of net changes that can be seen."""
    see = lambda c: F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{v}").alias(v) for v in visible]))
    shown = net.where(~see("before").eqNullSafe(see("after")))
    both = F.array(F.struct(F.lit("D").alias("op"), F.col("before").alias("row")), F.struct(F.lit("I").alias("op"), F.col("after").alias("row")))
    return shown.select("lsn", "xid", "ord", F.struct(*identity).alias("id"), F.explode(F.filter(both, lambda x: x["row"].isNotNull())).alias("d")).select("lsn", "xid", "ord", "id", "d.op", "d.row")


def feed(net: DataFrame, identity: Sequence[str], visible: Sequence[str], last: int) -> DataFrame:
    """(seq, lsn, xid, op, row) of net changes that can be seen, numbered on from ``last`` by transaction, first change
    in it and identity, the row before ahead of that after. For batches that a task can sort; see :func:`feed_parts`."""
    order = Window.orderBy("lsn", "ord", "id", "op")
    return feed_rows(net, identity, visible).select((F.lit(last) + F.row_number().over(order)).alias("seq"), "lsn", "xid", "op", "row")


def feed_parts(net: DataFrame, identity: Sequence[str], visible: Sequence[str]) -> DataFrame:
    """The rows of the feed in order, as (part, place, lsn, xid, op, row): ranges of the order are tasks of their own,
    however many rows a transaction has. What is written of it is numbered by the sums of its parts' rows."""
    order = ["lsn", "ord", "id", "op"]
    rows = feed_rows(net, identity, visible).repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return rows.select(F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), "lsn", "xid", "op", "row")


def merged(state: DataFrame, net: DataFrame, identity: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The state after net changes: untouched identities, and the last row of those that still exist."""
    last = net.groupBy(*identity).agg(F.max_by(F.struct("after"), "lsn").alias("last"))
    same = [last[c].eqNullSafe(state[c]) for c in identity]
    return state.join(last, same, "left_anti").select(*columns).unionByName(last.where("last.after is not null").select(*[F.col(f"last.after.{c}").alias(c) for c in columns]))
