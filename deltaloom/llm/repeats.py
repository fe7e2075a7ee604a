"""Operator 4: long repeats by prefix-free parsing, over all texts as UTF-8 bytes.

Every ``length``-byte string (a window) that occurs anywhere twice is found, and the bytes that such strings cover can be
cut out. Matches never cross documents.

Parsing. A rolling hash over ``core`` bytes triggers phrases: the trigger of a window is the place in it with the least
hash, so equal windows have equal triggers at equal places, and no window is without one. Consecutive windows with one
trigger make one phrase, from the first byte of the first to the last byte of the last; phrases overlap by a window less
one byte, so that each window lies whole in exactly one. A text is its sequence of phrases (the parse); distinct phrases
are the dictionary.

Combining. The corpus order of all windows is that of the dictionary's suffixes, each as often as the parse has its phrase:
as windows never reach beyond their phrase, suffixes of the parse are told apart by their first phrase, and counts of
phrases are the parse's suffix array to that depth. A phrase that the parse has twice repeats as a whole, and is looked
at no more than once: this is all that happens to whole copies and to the inside of long shared passages. A trigger that
occurs once has no repeats. What is left are different phrases with one trigger, that is the edges of repeats: the
suffix array of these phrases, by prefix doubling on their bytes up to ``length``, puts their windows in order, and
neighbours with a common prefix of ``length`` bytes repeat.

Only numbers are shuffled for all texts; texts are shuffled once to be joined with their repeated phrases, and only texts
that have any are kept for what follows. Counts are summed up before they are shuffled. The phrases of a trigger with more
than ``SHARE`` different ones, which may be any number, are not gathered in one task: their windows are counted by 128-bit
digests instead.

Defined results: a null text is empty; texts shorter than ``length`` bytes lose nothing; a row that occurs twice counts
twice, so it repeats itself; a null id is an id like others; after a cut in the middle of a character its remaining bytes
are dropped where text (not bytes) is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UNBASE, forget, fresh, mix64, powers, prefix_hash, ragged, slices, tasks, utf8, written

LENGTH, CORE = 400, 128
#: Different phrases of a trigger that a task may gather.
SHARE = 8192
#: Bytes of phrases that one suffix array is made of, about.
ARRAY = 1 << 20
_CHUNK = 8 << 20


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, in linear time."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def parse(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, trigger, phrase) of the phrases of texts in one buffer; first windows are
    places in the row."""
    none = np.zeros(0, np.int64)
    out = [(none, none, none, none.astype(np.uint64), none.astype(np.uint64))]
    for at in range(0, max(1, len(raw) - length + 1), _CHUNK):
        part = raw[at : at + _CHUNK + length - 1]
        if len(part) >= length:
            out.append(_parse(part, np.clip(offsets - at, 0, len(part)), offsets, at, length, core))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parse(raw: np.ndarray, offsets: np.ndarray, whole: np.ndarray, shift: int, length: int, core: int) -> tuple[np.ndarray, ...]:
    n = len(raw)
    sums, back = prefix_hash(raw), powers(n + 1, UNBASE, "unbase")
    hashes = mix64((sums[core:] - sums[:-core]) * back[: n - core + 1])
    # The place in the low bits makes the leftmost of equals the least.
    keys = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
    trigger = (window_least(keys, length - core + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    count = n - length + 1
    edges = np.zeros(n + 2, np.int32)
    starts, ends = offsets[:-1], offsets[1:] - length
    some = ends >= starts
    np.add.at(edges, starts[some], 1)
    np.add.at(edges, ends[some] + 1, -1)
    valid = np.cumsum(edges)[:count] > 0
    new = np.ones(count, bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | ~valid[:-1]
    new &= valid
    new[starts[some]] = True
    first = np.flatnonzero(new)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    windows = np.add.reduceat(valid.astype(np.int64), first)
    last = first + windows - 1
    phrase = mix64((sums[last + length] - sums[first]) * back[first] + (trigger[first] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + windows.astype(np.uint64))
    row = np.searchsorted(whole, first + shift, "right") - 1
    return row, first + shift - whole[row], windows, hashes[trigger[first]], phrase


def suffix_order(raw: np.ndarray, wanted: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The places of the ``length``-byte strings at ``wanted`` in their sorted order; equal strings have equal places.
    Prefix doubling: the order by 8 bytes, then by twice as many, from the order of both halves."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    width = 8
    while 2 * width <= length:
        behind = np.zeros(n, np.uint64)
        behind[: n - width] = rank[width:]
        rank = np.unique(rank << np.uint64(32) | behind, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        width *= 2
    return np.unique(rank[wanted] << np.uint64(32) | rank[wanted + (length - width)], return_inverse=True)[1]


def digests(raw: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the strings at some places of a text."""
    back = powers(len(raw) + 1, UNBASE, "unbase")[at]
    sums = prefix_hash(raw)
    one = mix64((sums[at + length] - sums[at]) * back)
    sums = prefix_hash(raw ^ np.uint8(0x5A))
    return one, mix64((sums[at + length] - sums[at]) * back + one)


KEY = ["_id", "_mark"]


def _key(docs: DataFrame) -> list[Column]:
    """What a row's text is known by: its id, and a digest of id and text. Rows that repeat have one key."""
    doc_id = docs["doc_id"].cast("long")
    return [F.coalesce(doc_id, F.lit(0)).alias("_id"), F.xxhash64(doc_id.cast("string"), _text(docs)).alias("_mark")]


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def repeated_phrases(docs: DataFrame, share: int, length: int) -> DataFrame:
    """(key.., phrases): of each text that has any, the phrases that repeat as a whole or may in part, as structs of first
    window, number of windows, trigger, whether the whole repeats, whether others of its trigger must be compared, and
    whether these are too many for a task."""
    core = length * CORE // LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = utf8(batch.column("text"))
            row, first, windows, trigger, phrase = parse(raw, offsets, length, core)
            keys = [batch.column(c).take(pa.array(row)) for c in KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(first), pa.array(windows.astype(np.int32)), pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64))], [*KEY, "first", "windows", "trigger", "phrase"])

    rows = docs.select(*_key(docs), _text(docs).alias("text")).where(F.octet_length("text") >= length)
    found = written(rows.mapInArrow(run, "_id long, _mark long, first long, windows int, trigger long, phrase long"), docs.sparkSession)
    # Joins with sums that are written, so that Spark can split their large parts: a phrase that fills a third of all text
    # is no single task's.
    spark = docs.sparkSession
    again = found.groupBy("trigger").agg(F.count("*").alias("n"), F.min("phrase").alias("a"), F.max("phrase").alias("b")).where("n > 1").select("trigger", (F.col("a") < F.col("b")).alias("several"))
    some = written(found.join(written(again, spark), "trigger"), spark)
    forget(found)
    at = F.struct(*KEY, "first")
    per_phrase = some.groupBy("trigger", "phrase", "several").agg(F.count("*").alias("same"), F.min(at).alias("least"))
    per_trigger = per_phrase.where("several").groupBy("trigger").agg((F.count("*") > share).alias("hot"))
    known = per_phrase.join(per_trigger, "trigger", "left").where("same > 1 or several").drop("several")
    some = some.drop("several").join(written(known, spark), ["trigger", "phrase"]).groupBy(*KEY, "first", "windows", "trigger").agg(F.max(F.struct("same", F.col("hot").isNotNull().alias("several"), F.coalesce("hot", F.lit(False)).alias("hot"), (at == F.col("least")).alias("least"))).alias("p"))
    item = F.struct("first", "windows", "trigger", (F.col("p.same") > 1).alias("whole"), (F.col("p.several") & F.col("p.least")).alias("compare"), F.col("p.hot").alias("hot"))
    return some.groupBy(*KEY).agg(F.collect_list(item).alias("phrases"))


def partial_repeats(texts: DataFrame, length: int) -> DataFrame:
    """(key.., first, places): which windows of a phrase that doesn't repeat as a whole occur elsewhere, from the suffix
    arrays of phrases with one trigger."""
    names = ["trigger", *KEY, "first", "whole", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for one, two, text, phrases in zip(*(batch.column(c).to_pylist() for c in KEY), batch.column("text"), batch.column("phrases").to_pylist(), strict=True):
                raw = memoryview(text.as_buffer())
                out += [(p["trigger"], one, two, p["first"], p["whole"], raw[p["first"] : p["first"] + p["windows"] - 1 + length]) for p in phrases if p["compare"] and not p["hot"]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = texts.mapInArrow(give, "trigger long, _id long, _mark long, first long, whole boolean, body binary")
    rows = rows.repartition(tasks(texts.sparkSession), "trigger").sortWithinPartitions("trigger")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, out = None, [], 0, []

        def close() -> None:
            """Windows that agree have one trigger, so one array can hold the phrases of several."""
            if len(held) > 1:
                raw = np.frombuffer(b"".join(h[4] for h in held), np.uint8)
                sizes = np.array([len(h[4]) for h in held], np.int64)
                windows = sizes - length + 1
                order = suffix_order(raw, ragged(np.cumsum(sizes) - sizes, windows), length)
                twice = np.bincount(order)[order] > 1
                ends = np.cumsum(windows)
                for (one, two, first, whole, _), a, b in zip(held, (ends - windows).tolist(), ends.tolist(), strict=True):
                    if not whole and twice[a:b].any():
                        out.append((one, two, first, np.flatnonzero(twice[a:b]).astype(np.int16)))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            counts = np.cumsum([0, *(len(x[3]) for x in out)]).astype(np.int32)
            places = np.concatenate([np.zeros(0, np.int16), *(x[3] for x in out)])
            made = pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in out], pa.int64()) for i in range(3)], pa.ListArray.from_arrays(pa.array(counts), pa.array(places))], [*KEY, "first", "places"])
            out.clear()
            return made

        for batch in batches:  # sorted by trigger
            for trigger, *rest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if trigger != now:
                    if size >= ARRAY:
                        close()
                        size = 0
                    now = trigger
                held.append(rest)
                size += len(rest[4])
            if len(out) > 20_000:
                yield batch_of()
        close()
        yield batch_of()

    return rows.mapInArrow(compare, "_id long, _mark long, first long, places array<smallint>")


def hot_repeats(texts: DataFrame, length: int) -> DataFrame:
    """As :func:`partial_repeats`, of triggers with any number of phrases: windows are counted by their digests."""
    names = [*KEY, "first", "place", "whole", "one", "two"]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for one, two, text, phrases in zip(*(batch.column(c).to_pylist() for c in KEY), batch.column("text"), batch.column("phrases").to_pylist(), strict=True):
                items = [p for p in phrases if p["compare"] and p["hot"]]
                if items:
                    first, windows = (np.array([p[c] for p in items], np.int64) for c in ("first", "windows"))
                    at, n = ragged(first, windows), int(windows.sum())
                    pair = digests(np.frombuffer(text.as_buffer(), np.uint8), at, length)
                    own = np.repeat(first, windows)
                    whole = np.repeat(np.array([p["whole"] for p in items]), windows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, one)), pa.array(np.full(n, two)), pa.array(own), pa.array((at - own).astype(np.int16)), pa.array(whole), *[pa.array(x.view(np.int64)) for x in pair]], names)

    rows = written(texts.where(F.exists("phrases", lambda p: p["hot"] & p["compare"])).mapInArrow(give, "_id long, _mark long, first long, place smallint, whole boolean, one long, two long"), texts.sparkSession)
    again = rows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
    return rows.where("not whole").join(again, ["one", "two"]).groupBy(*KEY, "first").agg(F.collect_list("place").alias("places"))


def cut_spans(n: int, phrases: list[dict], partial: list[dict] | None, length: int = LENGTH) -> np.ndarray:
    """The maximal runs [from, to) of bytes that repeated windows cover, as rows."""
    edge = np.zeros(n + 1, np.int32)
    for p in phrases:
        if p["whole"]:
            edge[p["first"]] += 1
            edge[p["first"] + p["windows"] - 1 + length] -= 1
    for p in partial or ():
        at = p["first"] + np.array(p["places"], np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
    covered = np.zeros(n + 2, np.int8)
    covered[1:-1] = np.cumsum(edge)[:n] > 0
    turns = np.flatnonzero(np.diff(covered))
    return turns.reshape(-1, 2)


def spans(docs: DataFrame, share: int = SHARE, length: int = LENGTH, words: int = 0) -> DataFrame:
    """(key.., n_removed, cuts, kept_sha256) of each text that has repeats; cuts: flat array of [from, to) byte places.
    ``words``: runs of fewer words than that are left alone."""
    spark = docs.sparkSession
    once = docs.select(*_key(docs), _text(docs).alias("text")).groupBy(*KEY).agg(F.first("text").alias("text"))
    texts = written(once.join(repeated_phrases(docs, share, length), KEY), spark)
    partial = partial_repeats(texts.where(F.exists("phrases", lambda p: p["compare"] & ~p["hot"])), length)
    if texts.where(F.exists("phrases", lambda p: p["compare"] & p["hot"])).limit(1).count():
        partial = partial.unionByName(hot_repeats(texts, length))
    partial = partial.groupBy(*KEY).agg(F.collect_list(F.struct("first", "places")).alias("partial"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, phrases, partial in zip(batch.column("text"), batch.column("phrases").to_pylist(), batch.column("partial").to_pylist(), strict=True):
                raw = memoryview(text.as_buffer())
                found = cut_spans(len(raw), phrases, partial, length)
                if words:
                    found = found[[len(bytes(raw[a:b]).split()) >= words for a, b in found.tolist()]]
                sha, at = hashlib.sha256(), 0
                for a, b in found.tolist():
                    sha.update(raw[at:a])
                    at = b
                sha.update(raw[at:])
                out.append((int((found[:, 1] - found[:, 0]).sum()), found.ravel().tolist(), sha.hexdigest()))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], *columns], [*KEY, "n_removed", "cuts", "kept_sha256"])

    return texts.join(partial, KEY, "left").mapInArrow(cut, "_id long, _mark long, n_removed long, cuts array<long>, kept_sha256 string").where("n_removed > 0")


def repeats(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    text = _text(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_key(docs), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    zero = F.lit(0).cast("long")
    joined = rows.join(spans(docs, **how), KEY, "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce((F.size("cuts") / 2).cast("long"), zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with all columns, the repeated bytes cut out of ``text`` (and ``n_chars``, if there is one, set anew). Only
    texts that lose something go to Python."""

    @F.arrow_udf("string")
    def without(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts, cuts.to_pylist(), strict=True):
            if own is None:
                out.append(None)
                continue
            raw, kept, at = memoryview(text.as_buffer()), [], 0
            for a, b in zip(own[::2], own[1::2], strict=True):
                kept.append(bytes(raw[at:a]).decode("utf-8", "ignore"))
                at = b
            kept.append(bytes(raw[at:]).decode("utf-8", "ignore"))
            out.append("".join(kept))
        return pa.array(out, pa.string())

    row, names = fresh(docs, "row"), {c: fresh(docs, c) for c in (*KEY, "cuts", "new")}
    found = spans(docs, **how).select(*[F.col(c).alias(names[c]) for c in (*KEY, "cuts")])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), *[k.alias(names[c]) for c, k in zip(KEY, _key(docs), strict=True)])
    rows = rows.join(found, [names[c] for c in KEY], "left")
    rows = rows.withColumn(names["new"], without(F.when(F.col(names["cuts"]).isNotNull(), F.col(f"{row}.text").cast("string")), names["cuts"]))
    kinds = {f.name: f.dataType for f in docs.schema}
    new = F.coalesce(names["new"], F.coalesce(F.col(f"{row}.text").cast("string"), F.lit("")))
    made = {"text": new.cast(kinds["text"])} | ({"n_chars": F.length(new).cast(kinds["n_chars"])} if "n_chars" in kinds else {})
    return rows.select(*[made.get(c, F.col(row)[c]).alias(c) for c in docs.columns])
