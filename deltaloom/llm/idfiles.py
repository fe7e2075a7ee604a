"""Operator 5: token ids in compressed binary files.

A file holds the documents of one range of ids in ascending order: an index (document ids, numbers of ids) and blocks of
a fixed number of ids, each coded by itself, with its length and its CRC-32. A block can be checked and decoded without
any other, so a reader skips to what it needs and a damaged block loses only itself.

The coder is a range coder over a mixture of three predictions, all learnt in the block alone: the id that followed the
same two ids last time (order 2), the id that followed the same id last time (order 1), and the frequencies of classes of
ids (order 0; within a class the low bits are uniform). The mixture's weights are the reliabilities that the order-2 and
order-1 predictions had so far at the same count of past successes. Everything is integer arithmetic, so files decode
alike on every machine.

As blocks are independent, one step of the coder runs for many blocks at once as one numpy operation.

Layout, little-endian: ``DLID``, u32 version, u64 documents, u64 ids, u32 ids in a block, u32 blocks, i64 document ids,
u32 lengths, then for each block u32 bytes and u32 CRC-32 of its ids as u32, then the blocks' bytes.

Defined results: a null or empty text has the end id alone; equal document ids are put in order of their text's digest; a
null document id comes first and is kept as null (the flag -2**63); ids are below 2**20.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, kept, pieces, ragged, scratch, slices, written

BLOCK = 4096
MAGIC = b"DLID"
#: Ids below 32 have a class each; above, each octave has 16.
EXACT, PER_OCTAVE, TOP_BITS = 32, 16, 20
CLASSES = EXACT + PER_OCTAVE * (TOP_BITS - 5)
ONE = 1 << 16
LEARN = 128
NONE = 0xFFFFFFFF
_first = np.concatenate([np.arange(EXACT), [(PER_OCTAVE + m) << (e - 4) for e in range(5, TOP_BITS) for m in range(PER_OCTAVE)]]).astype(np.int64)
_bits = np.concatenate([np.zeros(EXACT, np.int64), np.repeat(np.arange(5, TOP_BITS) - 4, PER_OCTAVE)])


class _Lanes:
    """The models and registers of n blocks that are coded side by side."""

    def __init__(self, n: int):
        self.n = n
        self.lane = np.arange(n)
        self.t1 = np.full((n, 1 << 12), NONE, np.uint32)  # id << 4 | count
        self.t2 = np.full((n, 1 << 13), NONE, np.uint32)
        self.c1 = np.tile((np.arange(16) * 3500 + 4000).astype(np.int64), (n, 1))
        self.c2 = np.tile((np.arange(16) * 3500 + 6000).astype(np.int64), (n, 1))
        self.counts = np.ones((n, CLASSES), np.int64)
        self.recent: list[np.ndarray] = []
        self.refresh()
        self.a = np.zeros(n, np.int64)
        self.b = np.zeros(n, np.int64)
        self.span = np.full(n, (1 << 48) - 1, np.uint64)

    def refresh(self) -> None:
        """New frequencies of classes; each has at least 64 of ONE."""
        if self.recent:
            got = np.stack(self.recent, 1)
            np.add.at(self.counts, (np.repeat(self.lane, got.shape[1]), got.ravel()), 12)
            self.recent = []
        total = self.counts.sum(1, keepdims=True)
        f = 64 + self.counts * (ONE - 64 * CLASSES) // total
        f[:, 0] += ONE - f.sum(1)
        self.cum = np.zeros((self.n, CLASSES + 1), np.int64)
        np.cumsum(f, 1, out=self.cum[:, 1:])

    def predict(self):
        k1 = (self.a * 0x9E5 >> 3) & 0xFFF
        k2 = ((self.a * 0x9E3779B1 + self.b * 0x85EBCA77) >> 11) & 0x1FFF
        self.f1, self.f2 = self.lane * (1 << 12) + k1, self.lane * (1 << 13) + k2
        e1, e2 = self.t1.ravel()[self.f1], self.t2.ravel()[self.f2]
        self.s1, self.s2 = self.lane * 16 + (e1 & 15).astype(np.int64), self.lane * 16 + (e2 & 15).astype(np.int64)
        self.e1, self.e2 = e1, e2
        p1, p2 = (e1 >> 4).astype(np.int64), (e2 >> 4).astype(np.int64)
        self.has2 = e2 != NONE
        self.has1 = (e1 != NONE) & ((p1 != p2) | ~self.has2)
        w2 = np.where(self.has2, self.c2.ravel()[self.s2], 0)
        w1 = np.where(self.has1, self.c1.ravel()[self.s1] * (ONE - w2) >> 16, 0)
        self.p1, self.p2, self.w1, self.w2 = p1, p2, w1, w2
        self.rest = ONE - w1 - w2

    def learn(self, x: np.ndarray, cls: np.ndarray) -> None:
        for has, p, c, s, t, f, e, has_any in ((self.has2, self.p2, self.c2, self.s2, self.t2, self.f2, self.e2, self.has2), (self.has1, self.p1, self.c1, self.s1, self.t1, self.f1, self.e1, self.e1 != NONE)):
            hit = has_any & (p == x)
            flat = c.reshape(-1)
            old = flat[s]
            step = np.where(hit, 58000 - old, 400 - old) >> 5
            flat[s] = np.where(has, old + step, old)
            count = (e & np.uint32(15)).astype(np.int64)
            t.reshape(-1)[f] = (x << 4 | np.where(hit, np.minimum(count + 1, 14), 0)).astype(np.uint32)
        self.recent.append(cls)
        if len(self.recent) == LEARN:
            self.refresh()
        self.b, self.a = self.a, x


def class_of(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(_first, x, "right") - 1


def encode_blocks(blocks: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The bytes of each row of ``blocks`` (n, width), of which the first ``lengths`` ids count."""
    n, width = blocks.shape
    if blocks.size and blocks.max() >= 1 << TOP_BITS:
        raise ValueError("ids of 2**20 and more are not supported")
    m = _Lanes(n)
    low = np.zeros(n, np.uint64)
    out = np.zeros((n, 2 * width + 8), np.int64)
    flat, row = out.reshape(-1), np.arange(n) * (2 * width + 8)
    at = np.ones(n, np.int64)  # out[:, 0] takes no word; carries never reach it
    mask48, s16, s32, s48 = np.uint64((1 << 48) - 1), np.uint64(16), np.uint64(1 << 32), np.uint64(48)

    def put(start, freq):
        nonlocal low
        r = m.span >> s16
        low = low + start.astype(np.uint64) * r
        flat[row + at - 1] += (low >> s48).astype(np.int64)
        low &= mask48
        m.span = r * freq.astype(np.uint64)
        small = m.span < s32
        flat[row + at] = np.where(small, low >> np.uint64(32), 0)
        at[small] += 1
        low = np.where(small, (low << s16) & mask48, low)
        m.span = np.where(small, m.span << s16, m.span)

    columns, classes = np.ascontiguousarray(blocks.T), class_of(np.ascontiguousarray(blocks.T))
    for t in range(width):
        live = lengths > t
        if not live.any():
            break
        x, cls = columns[t], classes[t]
        m.predict()
        in2, in1 = m.has2 & (m.p2 == x), m.has1 & (m.p1 == x)
        hit = in2 | in1
        c = m.lane * (CLASSES + 1) + cls
        lo, hi = m.rest * m.cum.ravel()[c] >> 16, m.rest * m.cum.ravel()[c + 1] >> 16
        start = np.where(in2, 0, np.where(in1, m.w2, m.w1 + m.w2 + lo))
        freq = np.where(in2, m.w2, np.where(in1, m.w1, hi - lo))
        put(np.where(live, start, 0), np.where(live, freq, ONE))
        bits = np.where(hit | ~live, 0, _bits[cls])
        if bits.any():
            unit = ONE >> bits
            put(np.where(bits > 0, (x - _first[cls]) * unit, 0), unit)
        m.learn(x, cls)
    ends = []
    for _ in range(3):
        flat[row + at] = (low >> np.uint64(32)).astype(np.int64)
        low = (low << s16) & mask48
        at += 1
        ends.append(at)
    for j in range(out.shape[1] - 1, 0, -1):  # carries, from the last word to the first
        out[:, j - 1] += out[:, j] >> 16
    words = (out & 0xFFFF).astype("<u2")
    return [words[i, 1 : at[i]].tobytes() for i in range(n)]


def decode_blocks(coded: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The ids of blocks, one row each, as wide as the longest."""
    n, width = len(coded), int(max(lengths, default=0))
    most = max(map(len, coded), default=0) // 2 + 8
    words = np.zeros((n, most), np.uint64)
    for i, c in enumerate(coded):
        words[i, : len(c) // 2] = np.frombuffer(c, "<u2")
    flat, row = words.reshape(-1), np.arange(n) * most
    m = _Lanes(n)
    code = words[:, 0] << np.uint64(32) | words[:, 1] << np.uint64(16) | words[:, 2]
    at = np.full(n, 3, np.int64)
    s16, s32 = np.uint64(16), np.uint64(1 << 32)

    def slot():
        m.r = m.span >> s16
        return np.minimum(code // m.r, np.uint64(ONE - 1)).astype(np.int64)

    def take(start, freq):
        nonlocal code
        code = code - start.astype(np.uint64) * m.r
        m.span = m.r * freq.astype(np.uint64)
        small = m.span < s32
        code = np.where(small, code << s16 | flat[row + np.minimum(at, most - 1)], code)
        at[small] += 1
        m.span = np.where(small, m.span << s16, m.span)

    out = np.zeros((width, n), np.int64)
    for t in range(width):
        live = lengths > t
        m.predict()
        v = slot()
        in2 = v < m.w2
        in1 = ~in2 & (v < m.w1 + m.w2)
        hit = in2 | in1
        v0 = np.maximum(v - m.w1 - m.w2, 0)
        cls, half, base, cum = np.zeros(n, np.int64), 1 << (CLASSES - 1).bit_length() - 1, m.lane * (CLASSES + 1), m.cum.ravel()
        while half:
            to = np.minimum(cls + half, CLASSES - 1)
            cls = np.where((m.rest * cum[base + to] >> 16) <= v0, to, cls)
            half >>= 1
        lo, hi = m.rest * cum[base + cls] >> 16, m.rest * cum[base + cls + 1] >> 16
        start = np.where(in2, 0, np.where(in1, m.w2, m.w1 + m.w2 + lo))
        freq = np.where(in2, m.w2, np.where(in1, m.w1, hi - lo))
        take(np.where(live, start, 0), np.where(live, freq, ONE))
        bits = np.where(hit | ~live, 0, _bits[cls])
        x = np.where(in2, m.p2, np.where(in1, m.p1, _first[cls]))
        if bits.any():
            unit = ONE >> bits
            low = np.where(bits > 0, slot() // unit, 0)
            take(low * unit, unit)
            x = x + low
        x = np.where(live, x, 0)
        out[t] = x
        m.learn(x, class_of(x))
    return out.T


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A whole file. Blocks are coded 1024 at a time."""
    n = -(-len(ids) // block)
    lengths = np.minimum(block, len(ids) - np.arange(n) * block)
    padded = np.zeros(n * block, np.int64)
    padded[: len(ids)] = ids
    coded: list[bytes] = []
    for i in range(0, n, 1024):
        coded += encode_blocks(padded[i * block : (i + 1024) * block].reshape(-1, block), lengths[i : i + 1024])
    sums = [zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) for i in range(n)]
    table = np.array([[len(c), s] for c, s in zip(coded, sums, strict=True)], "<u4").reshape(-1, 2)
    head = MAGIC + np.array([1], "<u4").tobytes() + np.array([len(doc_ids), len(ids)], "<u8").tobytes() + np.array([block, n], "<u4").tobytes()
    return head + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + table.tobytes() + b"".join(coded)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, counts, ids) of a file; each block is held against its checksum."""
    if data[:4] != MAGIC or np.frombuffer(data, "<u4", 1, 4)[0] != 1:
        raise ValueError("not a file of token ids")
    docs, total = map(int, np.frombuffer(data, "<u8", 2, 8))
    block, n = map(int, np.frombuffer(data, "<u4", 2, 24))
    doc_ids = np.frombuffer(data, "<i8", docs, 32)
    counts = np.frombuffer(data, "<u4", docs, 32 + 8 * docs).astype(np.int64)
    table = np.frombuffer(data, "<u4", 2 * n, 32 + 12 * docs).reshape(-1, 2).astype(np.int64)
    at = 32 + 12 * docs + 8 * n
    ends = at + np.cumsum(table[:, 0])
    lengths = np.minimum(block, total - np.arange(n) * block)
    ids = np.zeros(total, np.uint32)
    for i in range(0, n, 1024):
        part = decode_blocks([data[e - s : e] for e, s in zip(ends[i : i + 1024], table[i : i + 1024, 0], strict=True)], lengths[i : i + 1024])
        for j, (row, m) in enumerate(zip(part, lengths[i : i + 1024], strict=True)):
            own = row[:m].astype("<u4")
            if zlib.crc32(own.tobytes()) != table[i + j, 1]:
                raise ValueError(f"block {i + j} is damaged")
            ids[(i + j) * block : (i + j) * block + m] = own
    return doc_ids, counts, ids


#: Distinct pieces of text that a worker remembers the ids of.
MEMORY = 1 << 19


def library_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of texts by the tokenizers library. Texts are cut at ASCII white space, which its splitter drops, so
    each distinct piece is encoded once while the worker's memory holds it."""
    from tokenizers import Tokenizer

    mine = kept("idfiles")
    if path not in mine:
        mine[path] = (Tokenizer.from_file(path), {})
    library, memory = mine[path]
    offsets, index, distinct = pieces(column)
    if len(memory) > MEMORY:
        memory.clear()
    new = [x for x in distinct if x not in memory]
    for x, got in zip(new, library.encode_batch_fast(new, add_special_tokens=False), strict=True):
        memory[x] = np.array(got.ids, np.uint32).tobytes()
    found = [memory[x] for x in distinct]
    counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), np.uint32)
    starts = np.cumsum(counts) - counts
    sums = np.concatenate([[0], np.cumsum(counts[index])])
    return sums[offsets], flat[ragged(starts[index], counts[index])] if len(index) else flat[:0]


def encoded(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """doc_id and ids (binary: u16 each if all of the vocabulary's ids fit, else u32), the end id appended."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    kind = "<u2" if top < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", owner="idfiles"):
            offsets, ids = library_ids(batch.column("text"), path)
            n = batch.num_rows
            out = np.full(len(ids) + n, end_id, kind)
            starts = offsets[:-1] + np.arange(n)
            out[ragged(starts, np.diff(offsets))] = ids
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(((offsets + np.arange(n + 1)) * out.itemsize).astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data.cast(pa.binary()), pa.array([out.itemsize] * n, pa.int32())], ["doc_id", "ids", "width"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, width int")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_files(ids: DataFrame, folder: str, file_ids: int = 8_000_000) -> list[tuple[str, int, int]]:
    """Writes the rows of :func:`encoded` in ascending order of doc_id; (file, documents, ids) in that order. A task writes
    under a name of its own attempt, and only files of attempts that ended well are listed. One entry a file."""
    rows = ids.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        names, counts, parts = [], [], []
        made: list[tuple] = []

        def flush() -> None:
            if names:
                data = np.concatenate(parts)
                name = f"part-{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}.dlid"
                with files.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(pack(np.array(names, np.int64), np.array(counts, np.int64), data))
                made.append((task.partitionId(), len(made), f"{folder}/{name}", len(names), len(data)))
                names.clear(), counts.clear(), parts.clear()

        held = 0
        for batch in slices(batches, "ids"):
            for doc, data, width in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("width").to_pylist(), strict=True):
                own = np.frombuffer(data.as_buffer(), f"<u{width}").astype(np.uint32)
                names.append(-(1 << 63) if doc is None else doc)
                counts.append(len(own))
                parts.append(own)
                held += len(own)
                if held >= file_ids:
                    flush()
                    held = 0
        flush()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "k", "file", "docs", "ids"), x, strict=True)) for x in made], pa.schema([("part", pa.int32()), ("k", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    made = rows.mapInArrow(run, "part int, k int, file string, docs long, ids long").collect()
    return [(r["file"], r["docs"], r["ids"]) for r in sorted(made, key=lambda r: (r["part"], r["k"]))]


def read_files(spark: SparkSession, listed: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files; a file is a task."""
    starts, total = [], 0
    for file, _, n in listed:
        starts.append((file, total))
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                files, path = _open(file)
                with files.open_input_stream(path) as f:
                    docs, counts, ids = unpack(f.read())
                ends = np.cumsum(counts)
                data = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == -(1 << 63)), pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    frame = spark.createDataFrame(starts, "file string, start long").repartition(max(1, len(starts)), "file")
    return frame.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def id_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Encodes, writes, reads back."""
    spark = docs.sparkSession
    ids = written(encoded(docs, path, end_id), spark)  # the bounds of the ranges are found on it, so texts are encoded once
    files = write_files(ids, scratch(spark))
    forget(ids)
    return read_files(spark, files)
