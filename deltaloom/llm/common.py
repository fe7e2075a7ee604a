"""What several operators share: the shared scratch folder, Arrow slices, whitespace pieces and n-gram hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step works on at a time; bounds its memory whatever the number of rows in an Arrow batch.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch, about; Spark and the worker hold whole batches, which by rows alone have ten thousand texts.
BATCH_BYTES = 4 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share. Only where that is unset in a local
    session, as in tests, is a local folder made and set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="deltaloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/deltaloom-{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors, is computed once."""
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what :func:`written` wrote for frames that nothing reads any more."""
    for frame in frames:
        path = getattr(frame, "_written_to", None)
        if path:
            context = frame.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def row_digest(df: DataFrame) -> Column:
    """A digest of all columns; maps, which can't be hashed, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(df[f.name])) if "map<" in f.dataType.simpleString() else df[f.name] for f in df.schema.fields])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy() -> None:
    """Gives unused memory back to the system: workers live on after a task, several to an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What ``owner`` keeps in this worker from task to task. A worker lives on and runs all operators' tasks in turn, so
    what others kept goes."""
    for other in [x for x in _kept if x != owner]:
        del _kept[other]
    return _kept.setdefault(owner, {})


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` (string or binary) has about ``limit`` bytes in each; a longer value stays whole.
    ``owner``: whose :func:`kept` memories the task uses; the rest goes before the first batch is read."""
    kept(owner)
    tidy()
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        at = 0
        ends = np.cumsum(lengths)
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
        tidy()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, nulls as empty; offsets start at 0."""
    column = column.cast(pa.large_binary()).fill_null(b"") if not pa.types.is_large_binary(column.type) else column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random word for each byte, and the odd multiplier of the polynomial hash with its inverse modulo 2**64.
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9FB21C651E98DF25
UNBASE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of BYTE[raw[k]] * BASE**k for i <= k < j."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * powers(len(raw), BASE, "base"), out=out[1:])
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of bytes other than ASCII white space, in order; runs end with their row."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    left, right = word.copy(), word
    left[1:] &= edge[1:n] | ~word[:-1]
    starts = np.flatnonzero(left)
    last = word.copy()
    last[:-1] &= edge[1:n] | ~word[1:]
    ends = np.flatnonzero(last) + 1
    del right
    sums = prefix_hash(raw)
    hashes = (sums[ends] - sums[starts]) * powers(n, UNBASE, "unbase")[starts]
    return np.searchsorted(offsets, starts, "right") - 1, mix64(hashes)


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``words`` words; a row of fewer words, but some, has one shingle of them all."""
    row, word = word_hashes(raw, offsets)
    if not len(row):
        return row, word
    total, whole = word.copy(), np.ones(len(row), bool)
    for j in range(1, words):
        same = np.zeros(len(row), bool)
        same[:-j] = row[j:] == row[:-j] if j < len(row) else False
        shifted = np.zeros(len(row), np.uint64)
        shifted[:-j] = word[j:] if j < len(row) else 0
        total += np.where(same, shifted * np.uint64(pow(UNBASE, j, 1 << 64)), np.uint64(0))
        whole = same
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    keep = whole | first if words > 1 else whole
    return row[keep], mix64(total[keep])


def pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at ASCII white space: (row offsets, index of each piece in the list, distinct pieces)."""
    split = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return offsets - offsets[0], np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As :func:`pieces`, cut at Unicode white space."""
    found = pc.utf8_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    offsets = np.asarray(found.offsets).astype(np.int64)
    coded = found.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return offsets - offsets[0], np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. (counts[0] of them), starts[1], .."""
    ends = np.cumsum(counts)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out[:0]
    at = ends[full] - counts[full]
    out[at[0]] = starts[full[0]]
    out[at[1:]] = starts[full[1:]] - (starts[full[:-1]] + counts[full[:-1]] - 1)
    return np.cumsum(out)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each context, and bounds the session's Arrow batches
    by bytes, if they aren't bounded more closely."""
    import os
    import zipfile

    context, limit = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < context._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit)) <= BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    if getattr(context, "_deltaloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="deltaloom-"), "deltaloom.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("deltaloom", os.path.relpath(path, top)))
    context.addPyFile(name)
    context._deltaloom_shipped = True
