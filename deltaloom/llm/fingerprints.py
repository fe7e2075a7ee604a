"""Operator 7: document fingerprints as threshold-scaled sketches.

A document's shingles are its runs of five words. Every shingle hash below a fixed fraction of the hash space is kept, so
sketches of documents of any length can be merged by union and give unbiased containment and Jaccard estimates. Short
documents would keep almost nothing, so the ``floor`` least hashes are kept too; a sketch says below which bound it is
complete, and two sketches are compared below the smaller of their bounds. A document of at most ``floor`` shingles is
thus compared exactly.

Defined results: a null text is empty; an empty text has the empty sketch, which is like another empty one (1.0) and
unlike all others (0.0); a text of one to four words has one shingle; equal ids are put in order of their text's digest.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingles, slices, tasks, utf8

FULL = (1 << 64) - 1


def sketch_rows(column: pa.Array, fraction: int = 16, floor: int = 64) -> list[tuple[int, np.ndarray]]:
    """(bound, sorted hashes below or at it) for each text: all below 1/fraction of the hash space, and the least ``floor``."""
    raw, offsets = utf8(column)
    row, hashes = shingles(raw, offsets)
    ends = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    scaled = FULL // fraction
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = hashes[a:b]
        if b - a > 4 * floor * fraction:
            few = np.unique(own[own <= np.uint64(scaled)])
            if len(few) >= floor:
                out.append((scaled, few))
                continue
        own = np.unique(own)
        if len(own) <= floor:
            out.append((FULL, own))
        else:
            bound = max(scaled, int(own[floor - 1]))
            out.append((bound, own[: int(np.searchsorted(own, np.uint64(bound), "right"))]))
    return out


def to_text(sketch: tuple[int, np.ndarray]) -> str:
    return f"{sketch[0]:016x}:" + base64.b64encode(sketch[1].astype("<u8").tobytes()).decode()


def from_text(text: str) -> tuple[int, np.ndarray]:
    bound, _, body = text.partition(":")
    return int(bound, 16), np.frombuffer(base64.b64decode(body), "<u8")


def merge(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The sketch of two documents together."""
    bound = min(a[0], b[0])
    both = np.union1d(a[1], b[1])
    return bound, both[: int(np.searchsorted(both, np.uint64(bound), "right"))]


def _below(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    bound = np.uint64(min(a[0], b[0]))
    x, y = (s[: int(np.searchsorted(s, bound, "right"))] for s in (a[1], b[1]))
    return x, y, len(np.intersect1d(x, y, assume_unique=True))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The estimated Jaccard similarity of two documents' shingle sets."""
    x, y, both = _below(a, b)
    either = len(x) + len(y) - both
    return both / either if either else float(len(a[1]) == len(b[1]) == 0)


def containment(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The estimated part of a's shingles that b has."""
    x, _, both = _below(a, b)
    return both / len(x) if len(x) else float(len(a[1]) == 0)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, ahead, doc_id, text), range-partitioned by descending doc_id and sorted: within a partition the row
    that follows is the next document; the last row of each has ahead = true and is only there to be looked at. One
    shuffle of the texts: the bounds come from the ids, and what is sent twice is one row for each partition."""
    spark = docs.sparkSession
    n = tasks(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = rows.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = np.unique(np.array([int(x) for x in cuts], np.int64))[::-1].copy()

    @F.pandas_udf("int")
    def part(ids):
        import pandas as pd

        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(bounds), np.int32)  # null ids come last
        out[known] = len(bounds) - np.searchsorted(bounds[::-1], ids[known].to_numpy(np.int64), "right")
        return pd.Series(out)

    place = docs.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("part", part("doc_id"))
    tops = sorted((r["part"], r["top"]) for r in place.groupBy("part").agg(F.max("doc_id").alias("top")).collect())  # one row a partition
    keyed = rows.withColumn("part", part("doc_id"))
    nulls = [i for i, (_, top) in enumerate(tops) if top is None]
    known = np.array([top for _, top in tops if top is not None], np.int64)[::-1]  # ascending
    before = np.array([tops[i - 1][0] for i, (_, top) in enumerate(tops) if top is not None], np.int32)[::-1]
    before_nulls = tops[nulls[0] - 1][0] if nulls else -1

    @F.pandas_udf("int")
    def head(ids):
        """The part that must see this row as the first of the next part, or -1."""
        import pandas as pd

        out = np.full(len(ids), -1, np.int32)
        some = ids.notna().to_numpy()
        if len(known):
            values = ids[some].to_numpy(np.int64)
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            out[some] = np.where(known[at] == values, before[at], -1)
        out[~some] = before_nulls
        return pd.Series(out)

    keyed = keyed.withColumn("head", head("doc_id"))
    here, there = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead")), F.struct(F.col("head").alias("part"), F.lit(True).alias("ahead"))
    keyed = keyed.withColumn("to", F.explode(F.when(F.col("head") < 0, F.array(here)).otherwise(F.array(here, there)))).select("to.part", "to.ahead", "doc_id", "text")
    return keyed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pairs(rows: list[tuple], own: list) -> pa.RecordBatch:
        """Rows (doc_id, text) of which the last is only looked at; own: their sketches."""
        texts = [x[1] for x in rows]
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        new = sketch_rows(pa.array(changed, pa.large_string()))
        m = range(len(changed))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([to_text(own[i]) for i in m]), pa.array([to_text(x) for x in new]), pa.array([likeness(own[i], new[i]) for i in m], pa.float64()), pa.array([likeness(own[i], own[i + 1]) for i in m], pa.float64())],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, whose next is not known yet, and its sketch
        done = False
        for batch in slices(batches, "text"):
            if done:
                continue
            ahead = batch.column("ahead").to_pylist()
            if True in ahead:  # of those to look at, the first is the next document
                batch, done = batch.slice(0, ahead.index(True) + 1), True
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
            own = sketch_rows(batch.column("text"))
            if held:
                rows, own = [held[0], *rows], [held[1], *own]
            if len(rows) > 1:
                yield pairs(rows, own)
            held = [rows[-1], own[-1]]

    return with_next(docs).select("ahead", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
