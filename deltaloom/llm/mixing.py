"""Operator 2: mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed shuffled order, repeated up to ``repeats`` times. A copy's virtual
finish time is the tokens of its source up to and with it, divided by the source's target; the copies are then put in
order of finish time over all sources and taken while they fit in the total budget.

Both running sums are taken in two levels: rows are dealt to buckets of the shuffle order (then of finish time), each
bucket is summed by itself, and the sums of the buckets, of which there are few, are carried forward. So no source, and
not the whole, is ever sorted in one task; the second sum is needed only in the one bucket where the budget ends.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 take
nothing; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, row_digest, written

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """source, source_size, target of (source, source_size) rows, one for each source. The targets share the sum of all
    sizes by weight; what is above ``repeats`` times a source's size is shared again among the others. The level L at
    which sources are full solves it at once: target = min(repeats * size, L * weight), sources filling up in the order
    of repeats * size / weight. One row for each source; this sorts sources, not documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place.cast("int")).cast("double"))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    so_far = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    s = s.withColumn("cap", (F.col("source_size") * repeats).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    s = s.withColumn("budget", F.sum("source_size").over(everything).cast("double"))
    # If all up to this source are full, the others share the rest at this level:
    s = s.withColumn("left_weight", F.sum("weight").over(everything) - F.sum("weight").over(so_far) + F.col("weight"))
    s = s.withColumn("level", (F.col("budget") - (F.sum("cap").over(so_far) - F.col("cap"))) / F.col("left_weight"))
    s = s.withColumn("place", F.row_number().over(fill))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(everything)
    s = s.withColumn("final", first["level"])  # that of the first source that isn't filled
    return s.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, per_bucket: int = 20_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, source, text), and the columns ``carry``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(docs["text"].cast("string")).alias("size"), *carry)
    # The order within a source is that of the id's digest, so a later run, and another engine, shuffle alike.
    rows = written(rows.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), spark)
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    n = rows.count()
    digits = 1
    while 16**digits * per_bucket < n:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("turn", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    order = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("within", F.sum("size").over(order))
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    rows = rows.join(sums, same(rows, sums, "source", "bucket"), "left").select(rows["*"], sums["before"])
    rows = rows.join(plan, same(rows, plan, "source"), "left").select("doc_id", rows["source"], "size", "turn", "source_size", "target", *carry, (F.col("before") + F.col("within")).alias("upto"))
    rows = written(rows, spark)

    copies = rows.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"))
    copies = copies.withColumn("finish", (F.col("upto") + F.col("copy") * F.col("source_size")) / F.col("target"))
    # All finish times up to 1 fit: every source is then at most at its target. Time goes by in buckets of a budget's
    # share; the budget ends in one of them.
    width = max(16, 2 * (n // per_bucket))
    copies = copies.withColumn("slot", F.floor(F.col("finish") * width))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("s"))
    run = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    ends = slots.withColumn("upto_slot", F.sum("s").over(run)).join(F.broadcast(budget)).where("upto_slot > budget").agg(F.min("slot").alias("last"), F.min_by(F.col("budget") - (F.col("upto_slot") - F.col("s")), "slot").alias("room"))
    end = ends.first()  # one row
    last, room = (end["last"], end["room"]) if end["last"] is not None else (1 << 62, 0)
    close = Window.orderBy("finish", "turn", "doc_id", "source", "copy", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closing = copies.where(F.col("slot") == last).withColumn("sum", F.sum("size").over(close)).where(F.col("sum") <= room)
    cut = closing.agg(F.max(F.struct("finish", "turn", "doc_id", "source", "copy")).alias("c")).first()["c"]
    started = (F.col("upto") + F.col("k") * F.col("source_size")) / F.col("target")
    taken = F.floor(started * width) < last
    if cut is not None:
        key = F.struct(started.alias("finish"), "turn", "doc_id", "source", F.col("k").alias("copy"))
        limit = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["turn"]).alias("turn"), F.lit(cut["doc_id"]).cast("long").alias("doc_id"), F.lit(cut["source"]).cast("string").alias("source"), F.lit(cut["copy"]).alias("copy"))
        taken = taken | ((F.floor(started * width) == last) & (key <= limit))
    for k in range(repeats):
        rows = rows.withColumn("k", F.lit(k)).withColumn(f"take{k}", F.when((F.col("size") > 0) & taken, F.col("size")).otherwise(F.lit(0)).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", sum((F.col(f"take{k}") for k in range(1, repeats)), F.col("take0")).alias("taken"), *carry)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, with all their columns, as often as the mix takes them. The copies are found
    on narrow rows; texts are shuffled once, to be joined with their numbers. Rows are known by their id and a digest of
    all columns, so rows that share one are alike; they are summed up before they are shuffled. Documents without words
    are not taken."""
    row, key, copies = fresh(docs, "row"), fresh(docs, "key"), fresh(docs, "copies")
    doc_id = docs["doc_id"].cast("long")
    narrow = docs.select(doc_id.alias("doc_id"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"), row_digest(docs).alias("mark"))
    taken = mix(narrow, carry=("mark",), **how).where("taken > 0").groupBy(F.coalesce("doc_id", F.lit(0)).alias(key), F.col("mark").alias(f"{key}_mark")).agg(F.sum(F.expr("taken div size")).cast("int").alias(copies))
    once = docs.select(F.coalesce(doc_id, F.lit(0)).alias(key), row_digest(docs).alias(f"{key}_mark"), F.struct(*[docs[c] for c in docs.columns]).alias(row))
    once = once.groupBy(key, f"{key}_mark").agg(F.first(row).alias(row))
    return once.join(taken, [key, f"{key}_mark"]).select(row, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).select(f"{row}.*")
