"""Operator 1: n-gram Jaccard join by MinHash banding.

Documents are sets of five-word shingles; two are linked if they share a band and their Jaccard similarity is 0.8 or more.
Each document has ``BANDS`` times ``ROWS`` MinHash values; a band is the hash of its rows. With 18 bands of 5 rows, two
documents of similarity s share a band with probability 1 - (1 - s**5)**18: 99.92 % at 0.8, 99.997 % at 0.85; at 0.3, 4 %.

1. One pass over the texts makes of each document its set's digest, size and bands, which are written. Documents with equal
   sets are one class from here on (copies are never expanded), with the number of its documents as weight.
2. Bands that different classes share connect them to clusters, by the least class of each band. A band that a third of
   all classes share is summed up like any other key; pairs within a band are never made.
3. Only classes in clusters of two or more have their sets made again from the text, once a class. In a cluster of more
   than ``BLOCK`` classes chance collisions add up, so it is banded once more, selectively: ``MORE`` bands of more rows
   (0.17 % at 0.4, 99.94 % at 0.8) leave together what is similar.
4. A cluster that is still large is cut by size (0.8 or more needs sizes within 5/4) and then into blocks; every pair of
   blocks is a group of bounded size. Pairs of a group that share a band are verified on the full sets, as bit vectors over
   the shingles that more than one of them has. A group gives the number of links of each class and edges of a spanning
   forest, not the pairs. Groups run in two turns: first blocks with themselves and with the first block, then, told
   which classes these connect already, the others, which give edges between unconnected ones only. So edges stay in
   proportion to classes, though a group of n near copies has n * n / 2 links to be counted.
5. The edges are connected in turn.

Result: doc_id, class_id (the least doc_id of those that links connect it to, itself if none), n_links (documents at 0.8
or more, copies included). Defined results: a null or empty text, or white space alone, has no shingles and no links; a
text of one to four words has one shingle of them all; a null doc_id takes no part: its row has a null class and no
links; repeated rows are documents of their own, as are different texts under one id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, kept, mix64, shingles, slices, tasks, utf8, written

BANDS, ROWS, BLOCK = 18, 5, 512
#: Bands and their rows of the second, more selective banding.
MORE = (40, 8)
#: Shingles of a block, about: blocks of long documents have fewer of them, so a group's memory is bounded.
LOAD = 400_000
#: Bytes of text that shingles are made of at a time.
SLICE = 1 << 20
SIMILAR = 0.8


def signatures(row: np.ndarray, hashes: np.ndarray, n: int, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands) band hashes of n documents' shingles, of which ``row`` tells the document, in order."""
    at = np.searchsorted(row, np.arange(n))
    full = np.flatnonzero(np.diff(np.append(at, len(row))))
    out = np.zeros((n, bands), np.uint64)
    if not len(full):
        return out
    seeds = mix64((np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) + np.uint64(rows << 32)) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    for b in range(bands):
        band = np.full(len(full), b + 1, np.uint64)
        for r in range(rows):
            k = b * rows + r
            least = np.minimum.reduceat(hashes * seeds[2 * k] ^ seeds[2 * k + 1], at[full])
            band = mix64(band * np.uint64(0x9E3779B97F4A7C15) ^ least)
        out[full, b] = band
    return out


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the texts' shingles, sorted and each once; where each row begins; and each row's digest."""
    raw, offsets = utf8(texts)
    row, hashes = shingles(raw, offsets)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    n = len(texts)
    at = np.searchsorted(row, np.arange(n + 1))
    full = np.flatnonzero(np.diff(at))
    klass = np.zeros(n, np.uint64)
    if len(full):
        place = np.arange(len(row)) - at[row]
        klass[full] = mix64(np.add.reduceat(mix64(hashes + mix64(place.astype(np.uint64))), at[full]))
    return row, hashes, at, klass


def band_lists(bands: np.ndarray) -> pa.Array:
    n, width = bands.shape
    return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * width).astype(np.int32)), pa.array(bands.view(np.int64).ravel()))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a digest of the text) and text of the rows with an id: what a row is known by."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark"), "text")


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, mark, klass (digest of the shingle set), size, bands (array) of every row that has an id and a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            row, hashes, at, klass = shingle_sets(batch.column("text"))
            sizes = np.diff(at)
            made = band_lists(signatures(row, hashes, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(klass.view(np.int64)), pa.array(sizes.astype(np.int64)), made], ["doc_id", "mark", "klass", "size", "bands"]).filter(pa.array(sizes > 0))

    return _texts(docs).mapInArrow(run, "doc_id long, mark long, klass long, size long, bands array<long>")


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of the nodes of (a, b) edges, root the least node of the component. Each round every node takes the
    least label around it, then the label of its label; rounds are written, so lost executors cost one round."""
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), spark)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), spark)
    for _ in range(most):
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = written(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")), spark)
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            break
    else:
        raise RuntimeError(f"components aren't connected after {most} rounds")
    return labels


def clusters(classes: DataFrame) -> DataFrame:
    """(klass, cluster) of the classes that share a band with another, from rows (klass, bands), which may repeat. A band
    stands for the star of its least class with every other. Of the least classes of all its bands, which are few, a
    class is joined to the least, and so are the others of them: about one edge a class, however many bands it shares."""
    exploded = classes.select("klass", F.posexplode("bands").alias("k", "band")).select("klass", F.xxhash64("k", "band").alias("band"))
    shared = exploded.groupBy("band").agg(F.min("klass").alias("least"), F.max("klass").alias("most")).where("least < most").select("band", "least")
    stars = exploded.join(shared, "band").groupBy("klass").agg(F.collect_set("least").alias("of"))
    edges = stars.select(F.explode(F.array_union("of", F.array("klass"))).alias("a"), F.array_min("of").alias("b")).where("a <> b").distinct()
    return connected(edges).select(F.col("node").alias("klass"), F.col("root").alias("cluster"))


def refined(sets: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """(klass, cluster): of ``found``, clusters of more than ``block`` classes parted by the selective banding."""
    large = written(found.groupBy("cluster").agg(F.count("*").alias("m")).where(F.col("m") > block).select("cluster"), found.sparkSession)
    if not large.limit(1).count():
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "hashes", SLICE):
            raw, offsets = utf8(batch.column("hashes"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8)
            yield pa.RecordBatch.from_arrays([batch.column("klass"), band_lists(signatures(row, raw.view(np.uint64), batch.num_rows, *MORE))], ["klass", "bands"])

    inside = found.join(large, "cluster", "left_semi").select("klass")
    again = written(sets.join(inside, "klass", "left_semi").select("klass", "hashes").mapInArrow(run, "klass long, bands array<long>"), found.sparkSession)
    return found.join(large, "cluster", "left_anti").select("klass", "cluster").unionByName(clusters(again))


def placed(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(klass, own, groups) from (klass, cluster, size): the groups that a class must be in, so that any two of a cluster
    that can be similar meet in exactly one. A small cluster is one group. A large one is cut by the power of 5/4 of the
    size, and each part into blocks by digest; a block meets the blocks of its own and of the next part. ``early``: the
    group is of the first turn."""
    total = members.groupBy("cluster").agg(F.when(F.sum("size") <= LOAD, F.count("*")).otherwise(F.lit(1 << 62)).alias("m"))
    members = members.withColumn("step", F.floor(F.log("size") / math.log(1.25) + 1e-9).cast("long"))
    parts = members.groupBy("cluster", "step").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.greatest(F.lit(2.0), F.least(F.lit(float(block)), LOAD / F.pow(F.lit(1.25), F.col("step") + 1))))
    parts = parts.withColumn("k", blocks)
    up = parts.select("cluster", (F.col("step") - 1).alias("step"), F.col("k").alias("k_up"))
    down = parts.select("cluster", (F.col("step") + 1).alias("step"), F.col("k").alias("k_down"))
    parts = parts.join(up, ["cluster", "step"], "left").join(down, ["cluster", "step"], "left").join(total, "cluster")
    rows = members.join(parts.select("cluster", "step", "k", F.coalesce("k_up", F.lit(0)).alias("k_up"), F.coalesce("k_down", F.lit(0)).alias("k_down"), "m"), ["cluster", "step"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("klass", F.lit(3)), "k"))
    name = lambda s, i, t, j: F.xxhash64("cluster", s, i, t, j)
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    side = lambda n, make: F.transform(span(n), make)
    early = lambda i, j: (F.least(i, j) == 0) | (i == j)
    own = F.col("own")
    mine = side(F.col("k"), lambda j: F.struct(name(F.col("step"), F.least(own, j), F.col("step"), F.greatest(own, j)).alias("group"), F.when(j == own, F.lit(3)).otherwise(F.lit(0)).alias("side"), early(own, j).alias("early")))
    above = side(F.col("k_up"), lambda j: F.struct(name(F.col("step"), own, F.col("step") + 1, j).alias("group"), F.lit(1).alias("side"), (F.least(own, j) == 0).alias("early")))
    below = side(F.col("k_down"), lambda j: F.struct(name(F.col("step") - 1, j, F.col("step"), own).alias("group"), F.lit(2).alias("side"), (F.least(own, j) == 0).alias("early")))
    one = F.array(F.struct(F.xxhash64("cluster").alias("group"), F.lit(3).alias("side"), F.lit(True).alias("early")))
    return rows.select("klass", "own", F.when(F.col("m") <= block, one).otherwise(F.concat(mine, above, below)).alias("groups"))


def similar_pairs(sets: list[np.ndarray], bands: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the j > i that share a band with set i and have a Jaccard similarity of 0.8 or more with it), exact on the
    full sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    partners = []
    for i in range(n - 1):
        near = (bands[i + 1 :] == bands[i]).any(1)
        near &= (5 * sizes[i + 1 :] >= 4 * sizes[i]) & (4 * sizes[i + 1 :] <= 5 * sizes[i])
        partners.append(i + 1 + np.flatnonzero(near))
    if not any(map(len, partners)):
        return
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    del order
    new = np.ones(len(everything), bool)
    new[1:] = everything[1:] != everything[:-1]
    place = np.cumsum(new, dtype=np.int32) - 1
    often = np.bincount(place)
    wanted = np.flatnonzero(often > 1)  # a shingle of one document is in no intersection
    renumber = np.full(len(often), -1, np.int32)
    renumber[wanted] = np.arange(len(wanted), dtype=np.int32)
    column = renumber[place]
    keep = column >= 0
    column, owner = column[keep], owner[keep]
    both = [np.zeros(len(p), np.int32) for p in partners]
    cut = 1 << 14
    for low in range(0, len(wanted), cut):
        a, b = np.searchsorted(column, [low, low + cut])
        width = min(cut, len(wanted) - low)
        bits = np.zeros((n, -(-width // 64) * 64), bool)
        bits[owner[a:b], column[a:b] - low] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i, p in enumerate(partners):
            if len(p):
                both[i] += np.bitwise_count(words[p] & words[i]).sum(1, dtype=np.int32)
    for i, p in enumerate(partners):
        common = both[i].astype(np.int64)
        yield i, p[5 * common >= 4 * (sizes[i] + sizes[p] - common)]


def verified(sets: DataFrame) -> DataFrame:
    """From rows (group, side, own, klass, weight, root, bands, hashes), sorted by group: rows (klass, links, other).
    ``links``: documents of other classes that are similar; ``other``: an edge of the group's spanning forest, or null.
    Classes with one ``root`` are known to be connected."""

    def one(sides: list[int], own: list[int], klass: list[int], weight: list[int], roots: list[int], bands: list[np.ndarray], hashes: list[np.ndarray]) -> Iterator[tuple]:
        links, parent = [0] * len(klass), {r: r for r in roots}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, found in similar_pairs(hashes, np.stack(bands)):
            for j in found.tolist():
                # A whole cluster and a block with itself (3) count all pairs; two blocks of one part (0) and of two
                # parts (1, 2) only those across, as each block has a group of its own.
                if sides[i] == 3 or (own[i] != own[j] if sides[i] == 0 else sides[i] != sides[j]):
                    links[i] += weight[j]
                    links[j] += weight[i]
                    a, b = find(roots[i]), find(roots[j])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        yield klass[i], 0, klass[j]
        for i, n in enumerate(links):
            if n:
                yield klass[i], n, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("")
        now, held = None, {}
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                out.extend(one(*map(list, zip(*held.values(), strict=True))))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["klass", "links", "other"])
            out.clear()
            return made

        for batch in batches:  # sorted by group: one is held at a time
            cols = [batch.column(c).to_pylist() for c in ("group", "side", "own", "klass", "weight", "root")]
            bands = batch.column("bands").flatten().to_numpy().reshape(batch.num_rows, -1)
            for i, (group, *rest) in enumerate(zip(*cols, strict=True)):
                if group != now:
                    close()
                    now = group
                # Copies, so the batch can go.
                held.setdefault(rest[2], (*rest, bands[i].copy(), np.frombuffer(batch.column("hashes")[i].as_py(), np.uint64)))
            if len(out) > 50_000:
                yield batch_of()
        close()
        yield batch_of()

    return sets.mapInArrow(run, "klass long, links long, other long")


def with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(klass, bands, hashes): the sorted shingle hashes of the classes of ``wanted`` (klass, first, mark), made from the
    text that has that id and mark."""
    rows = _texts(docs).join(wanted.select(F.col("first").alias("doc_id"), "mark", "klass"), ["doc_id", "mark"])
    rows = rows.groupBy("klass").agg(F.first("text").alias("text"))  # a row may repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            row, hashes, at, _ = shingle_sets(batch.column("text"))
            made = [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("klass"), band_lists(signatures(row, hashes, batch.num_rows)), pa.array(made, pa.binary())], ["klass", "bands", "hashes"])

    return rows.mapInArrow(run, "klass long, bands array<long>, hashes binary")


def linked(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(the sketched rows; klass, first, mark, weight, root, links of every class). ``first`` and ``mark`` tell the class's
    first row, ``root`` is the least class that links connect it to, ``links`` counts documents of other classes."""
    spark = docs.sparkSession
    made = written(sketched(docs), spark)
    classes = made.groupBy("klass").agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.count("*").alias("weight"), F.max("size").alias("size"))
    classes = written(classes.select("klass", F.col("one.doc_id").alias("first"), F.col("one.mark").alias("mark"), "weight", "size"), spark)
    found = written(clusters(made.select("klass", "bands")), spark)
    sets = written(with_sets(docs, classes.join(found, "klass", "left_semi")), spark)
    found = written(refined(sets, found, block), spark)
    groups = placed(classes.select("klass", "size").join(found, "klass"), block)
    groups = written(groups.join(classes.select("klass", "weight"), "klass"), spark)

    def turn(which: DataFrame) -> DataFrame:
        rows = which.select("klass", "own", "weight", "root", F.explode("groups").alias("g")).join(sets, "klass")
        rows = rows.select("g.group", "g.side", "own", "klass", "weight", "root", "bands", "hashes")
        return written(verified(rows.repartition(tasks(spark), "group").sortWithinPartitions("group", "klass")), spark)

    edges_of = lambda t: t.where("other is not null").select(F.col("klass").alias("a"), F.col("other").alias("b"))
    at = lambda early: F.filter("groups", lambda g: g["early"] == F.lit(early))
    checked = turn(groups.withColumn("root", F.col("klass")).withColumn("groups", at(True)))
    roots = written(connected(edges_of(checked)), spark)
    late = groups.withColumn("groups", at(False)).where(F.size("groups") > 0)
    if late.limit(1).count():
        known = late.join(roots.withColumnRenamed("node", "klass"), "klass", "left").withColumn("root", F.coalesce("root", "klass"))
        more = turn(known)
        if edges_of(more).limit(1).count():
            roots = connected(edges_of(checked).unionByName(edges_of(more)))
        checked = checked.unionByName(more)
    links = checked.groupBy("klass").agg(F.sum("links").alias("links"))
    out = classes.join(roots.withColumnRenamed("node", "klass"), "klass", "left").join(links, "klass", "left")
    out = out.select("klass", "first", "mark", "weight", F.coalesce("root", "klass").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    return made, out


def _apart(doc_id: Column, text: Column) -> Column:
    """Rows without an id or a shingle."""
    return doc_id.isNull() | ~F.coalesce(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def join(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs`` (doc_id, text)."""
    made, classes = linked(docs, block)
    least = classes.groupBy("root").agg(F.min("first").alias("class_id"))
    per_class = classes.join(least, "root").select("klass", "class_id", (F.col("weight") - 1 + F.col("links")).alias("n_links"))
    with_class = made.select("doc_id", "klass").join(per_class, "klass").select("doc_id", "class_id", "n_links")
    rest = docs.where(_apart(docs["doc_id"], docs["text"])).select(docs["doc_id"].cast("long").alias("doc_id"))
    return with_class.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first (by doc_id, then digest of the text) of those that
    links connect. Rows without an id or a shingle stay; of rows that repeat id and text one stays."""
    _, classes = linked(docs, block)
    first = classes.groupBy("root").agg(F.min(F.struct("first", "mark")).alias("one"))
    key, mark, row = fresh(docs, "key"), fresh(docs, "mark"), fresh(docs, "row")
    first = first.select(F.col("one.first").alias(key), F.col("one.mark").alias(mark))
    apart = _apart(docs["doc_id"], docs["text"])
    # Repeated rows are summed up before they are shuffled.
    once = docs.where(~apart).select(F.col("doc_id").cast("long").alias(key), F.xxhash64(docs["text"].cast("string")).alias(mark), F.struct(*[docs[c] for c in docs.columns]).alias(row))
    once = once.groupBy(key, mark).agg(F.first(row).alias(row)).join(first, [key, mark], "left_semi").select(f"{row}.*")
    return once.unionByName(docs.where(apart))
