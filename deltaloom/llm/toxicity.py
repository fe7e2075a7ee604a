"""Operator 3: toxicity by maximum-scoring segments.

Learning. Every word, and the beginning of every longer word, gets its log-odds between toxic and clean labelled
documents, with a Dirichlet prior, counted once a document; the score is the log-odds less ``sure`` of its standard errors,
so rare words prove nothing, and a word must stand in two toxic documents. A word that is no evidence itself, and that
clean documents don't use either, takes the score of its beginning. Every token pays a fixed price, so that a clean text's
running sum falls.

Scoring. One scan over a document's tokens finds all maximal-scoring segments (each has the highest sum around it, and
they are disjoint): its passages. By Karlin and Altschul, the best sum of a clean text of n tokens has an extreme-value
distribution, so a segment of sum S counts lambda * S - ln(K * n): what is above 0 is significant. The document's best
such value and the sum of all significant ones go into a logistic curve.

Calibration is cross-fitted: for each of three folds, words learnt from the other two score its documents, so lambda, K and
the curve come from documents that the words were not learnt from. ``sure`` is the one of ``SURES`` whose curve explains the
labels best; the words of the model then come from all three folds.

The model is learnt from at most ``rows`` labelled documents (a documented bound; those with the least digest of their
id), so its words, all of which are kept, are bounded by theirs and may be sent to every executor; scoring reads every
document once, without a shuffle. Labels, languages, sources and ids are never looked at in scoring.

Defined results: a null or empty text has the score of no evidence; a table without labels, or with one kind of label
only, scores every text 0; labels other than 0 and 1 are left out; a null id is not held out; of labelled rows that repeat
an id the least text is learnt from. Words end at Unicode white space. With few labels few toxic words are known: of 11
toxic documents among 87 labelled ones, one model found about half.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split, written

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PRICE, PRIOR = 0.7, 0.5
SURES = (2.0, 1.5, 1.0)
#: Lengths of a longer word's beginnings.
STEMS = (4, 5, 6, 7, 8)
HELD_OUT = 2
FOLDS = (0, 1, 3)
THRESHOLD = 0.3
#: Pieces of text that a worker remembers the scores of, and features that it counts before it hands them on.
MEMORY, COUNTED = 1 << 17, 1 << 18


def plain(piece: str) -> str:
    return EDGE.sub("", piece.lower())


def features_of(word: str) -> tuple[str, ...]:
    return (word, *(f"^{word[:n]}" for n in STEMS if len(word) > n))


@dataclass
class Model:
    scores: dict[str, float]
    used: set[str]
    rate: float = 1.0
    size: float = 1.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    empty: bool = False

    def token(self, piece: str) -> float:
        word = plain(piece)
        own = self.scores.get(word)
        if own is None and word not in self.used:
            own = max((self.scores.get(f, 0.0) for f in features_of(word)[1:]), default=0.0)
        return (own or 0.0) - PRICE


@dataclass
class Tried:
    """Several models' scores side by side: rows of words, a column a model; and the words that take no beginning's."""

    words: dict[str, int]
    scores: np.ndarray
    others: dict[str, int]
    used: np.ndarray

    def table(self, pieces: list[str]) -> np.ndarray:
        """Each piece's score in each model, as :meth:`Model.token` gives it."""
        out = np.full((len(pieces), self.scores.shape[1]), -PRICE, np.float32)
        none = np.zeros(self.scores.shape[1], np.float32)
        for i, piece in enumerate(pieces):
            word, *stems = features_of(plain(piece))
            at = self.words.get(word)
            own = none if at is None else self.scores[at]
            rows = [self.words[s] for s in stems if s in self.words]
            if rows:
                begin = self.scores[rows].max(0)
                if word in self.others:
                    begin = np.where(self.used[self.others[word]], 0, begin)
                own = np.where(own > 0, own, begin)
            out[i] += own
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [from, to) with their sums, in linear time. Only tokens above 0 begin or end one."""
    up = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # from, to, sum before it, sum with it
    for i in up.tolist():
        a, b, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                break
            a, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((a, b, left, right))
    return [(a, b, right - left) for a, b, left, right in stack]


def evidence(model: Model, scores: np.ndarray) -> tuple[float, float, int]:
    """(best normal score, sum of the significant ones, number of significant segments) of a document's tokens."""
    n = len(scores)
    if not n or not (scores > 0).any():
        return 0.0, 0.0, 0
    values = [model.rate * s - math.log(max(1.0, model.size * n)) for _, _, s in segments(scores)]
    over = [v for v in values if v > 0]
    return max(0.0, max(values)), sum(over), len(over)


def extreme_value(scores: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of the token scores of clean texts: lambda solves sum p * exp(lambda * s) = 1; K, for which there is
    only a series, is taken from its first term."""
    p = weights / weights.sum()
    if (scores > 0).sum() == 0 or (p * scores).sum() >= 0:
        return 1.0, 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * scores, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    rate = (low + high) / 2
    return rate, min(1.0, float((p * scores).sum() ** 2 / max(1e-12, (p * scores * np.exp(np.minimum(rate * scores, 700))).sum() * rate)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, fold) of at most ``rows`` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.withColumn("fold", _remainder()).where(F.col("fold") != HELD_OUT)
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "toxic").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text")).select("text", "toxic", "fold")


def _bound(t, c, toxic: int, clean: int, sure: float):
    """The log-odds of features less ``sure`` standard errors; for columns as for arrays."""
    log, sqrt = (np.log, np.sqrt) if isinstance(t, np.ndarray) else (F.log, F.sqrt)
    t, c = t + PRIOR, c + PRIOR
    return log(t / (toxic + 2 * PRIOR)) - log(c / (clean + 2 * PRIOR)) - sure * sqrt(1 / t + 1 / c)


def learn(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Model:
    """The model of the labelled documents outside of the held-out rows."""
    spark = docs.sparkSession
    texts = written(_labelled(docs, labels, rows), spark)  # at most ``rows``; read a few times

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, ...] = tuple(Counter() for _ in range(6))  # by fold and label

        def rows_of() -> pa.RecordBatch:
            names = list(set().union(*found))
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([f[x] for x in names], pa.int64()) for f in found]], ["feature", *counts])
            for f in found:
                f.clear()
            return out

        for batch in slices(batches, "text"):
            offsets, index, distinct = split(batch.column("text"))
            own_features = [features_of(w) if (w := plain(p)) else () for p in distinct]
            for a, b, toxic, fold in zip(offsets[:-1], offsets[1:], batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                to = found[2 * FOLDS.index(fold) + toxic]
                to.update({f for i in set(index[a:b].tolist()) for f in own_features[i]})
                to[""] += 1  # documents
            if sum(map(len, found)) > COUNTED:
                yield rows_of()
        yield rows_of()

    counts = [f"{k}{i}" for i in range(3) for k in "ct"]
    learnt = texts.mapInArrow(count, ", ".join(["feature string", *(f"{c} long" for c in counts)])).groupBy("feature").agg(*[F.sum(c).alias(c) for c in counts])
    learnt = written(learnt, spark)
    n = learnt.where("feature = ''").first()
    if n is None:
        return Model({}, set(), empty=True)
    sums = {"c": [n[f"c{i}"] for i in range(3)], "t": [n[f"t{i}"] for i in range(3)]}
    if not sum(sums["c"]) or not sum(sums["t"]):
        return Model({}, set(), empty=True)
    # The sets of folds that words are learnt from: all but one, in turn, and all.
    sets = [[i for i in range(3) if i != left] for left in range(3)] + [[0, 1, 2]]
    some = [s for s in sets if sum(sums["t"][i] for i in s) and sum(sums["c"][i] for i in s)]
    over = lambda s: _bound(sum(F.col(f"t{i}") for i in s), sum(F.col(f"c{i}") for i in s), sum(sums["t"][i] for i in s), sum(sums["c"][i] for i in s), SURES[-1]) > 0
    any_over = over(some[-1])
    for s in some[:-1]:
        any_over = any_over | over(s)
    # Bounded by the words of the labelled documents.
    good = learnt.where("feature != '' and t0 + t1 + t2 >= 2").where(any_over).toPandas()
    begin = [(f[1:],) for f in good["feature"] if f.startswith("^")]
    others = learnt.where("feature = 'no'").limit(0)
    if begin:
        begins = spark.createDataFrame(begin, "begin string")
        stems = F.array(*[F.substring("feature", 1, n) for n in STEMS])
        others = learnt.where((F.col("c0") + F.col("c1") + F.col("c2") >= 2) & ~F.col("feature").startswith("^")).select("*", F.explode(stems).alias("begin"))
        others = others.join(begins, "begin", "left_semi").drop("begin").distinct()
    others = others.toPandas()

    def scores_of(s: list[int], sure: float) -> tuple[np.ndarray, np.ndarray]:
        """The scores of the words in ``good`` by the counts of some folds, 0 where they prove nothing; and which of
        ``others`` clean documents use, so that they don't take the score of their beginning."""
        if s not in some:
            return np.zeros(len(good)), np.zeros(len(others), bool)
        total = [sum(sums[k][i] for i in s) for k in "tc"]
        of = lambda frame, k: sum(frame[f"{k}{i}"].to_numpy(float) for i in s)
        value = np.where(of(good, "t") >= 2, _bound(of(good, "t"), of(good, "c"), *total, sure), 0)
        return np.maximum(value, 0), (of(others, "c") >= 2) & (_bound(of(others, "t"), of(others, "c"), *total, sure) <= 0)

    folds = len(sets) - 1
    made = [scores_of(sets[left], sure) for sure in SURES for left in range(folds)]
    tried = spark.sparkContext.broadcast(Tried(dict(zip(good["feature"], range(len(good)), strict=True)), np.stack([x[0] for x in made], 1).astype(np.float32), dict(zip(others["feature"], range(len(others)), strict=True)), np.stack([x[1] for x in made], 1)))
    highest = [max([float(x[0].max(initial=0)) for x in made[k * folds : (k + 1) * folds]]) for k in range(len(SURES))]

    def heights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each token score occurs in clean documents."""
        seen: Counter = Counter()
        for batch in slices(batches, "text"):
            offsets, index, distinct = split(batch.column("text"))
            clean, fold = batch.column("toxic").to_numpy() == 0, batch.column("fold").to_numpy()
            row, table = np.repeat(np.arange(batch.num_rows), np.diff(offsets)), tried.value.table(distinct)
            for left in range(folds):
                uses = np.bincount(index[(clean & (fold == FOLDS[left]))[row]], minlength=len(distinct))
                for k in range(len(SURES)):
                    values, at = np.unique(table[:, k * folds + left], return_inverse=True)
                    for v, n in zip(values.tolist(), np.bincount(at, uses, len(values)).tolist(), strict=True):
                        seen[k, v] += int(n)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.int32()), pa.array([x[1] for x in seen], pa.float64()), pa.array(list(seen.values()), pa.int64())], ["k", "score", "n"])

    rates = []
    histogram = texts.mapInArrow(heights, "k int, score double, n long").groupBy("k", "score").agg(F.sum("n").alias("n")).where("n > 0").toPandas()  # a row for each score of a word
    for k in range(len(SURES)):
        own = histogram[histogram["k"] == k].sort_values("score")
        # One clean token more of the greatest score, as what never occurred in so many tokens may occur.
        top = (highest[k] or 1.0) - PRICE
        rates.append(extreme_value(np.append(own["score"].to_numpy(float), [top, -PRICE]), np.append(own["n"].to_numpy(float), [1.0, 1.0])) if len(own) else (1.0, 1.0))

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model({}, set(), *rate) for rate in rates]
        for batch in slices(batches, "text"):
            offsets, index, distinct = split(batch.column("text"))
            table = tried.value.table(distinct)
            out = np.zeros((batch.num_rows, len(SURES), 2))
            for i, fold in enumerate(batch.column("fold").to_pylist()):
                own = table[index[offsets[i] : offsets[i + 1]]][:, FOLDS.index(fold) :: folds].astype(float)
                for k in range(len(SURES)):
                    out[i, k] = evidence(models[k], own[:, k])[:2]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(out[:, k, j]) for k in range(len(SURES)) for j in range(2)]], ["toxic", *names])

    names = [f"{x}{k}" for k in range(len(SURES)) for x in ("best", "total")]
    sample = texts.mapInArrow(evidences, ", ".join(["toxic int", *(f"{x} double" for x in names)])).toPandas()  # at most ``rows`` small rows
    y = sample["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return Model({}, set(), empty=True)
    best: tuple | None = None
    for k, sure in enumerate(SURES):
        x = np.log1p(sample[[f"best{k}", f"total{k}"]].to_numpy(float))
        order = np.lexsort((y, x[:, 1], x[:, 0]))  # sums don't depend on the order of rows
        x, own = x[order], y[order]
        curve = fit_curve(x, own)
        z = curve[0] + x @ np.array(curve[1:])
        likely = -float(np.logaddexp(0, np.where(own > 0, -z, z)).sum())
        if best is None or likely > best[0] + 1e-9:
            best = (likely, k, sure, curve)
    _, k, sure, curve = best
    tried.destroy()
    value, busy = scores_of(sets[-1], sure)
    scores = {f: float(v) for f, v in zip(good["feature"], value, strict=True) if v > 0}
    return Model(scores, set(others["feature"][busy]), *rates[k], curve)


class Reader:
    """Scores columns of texts; remembers a bounded number of pieces."""

    def __init__(self, model: Model):
        self.model = model
        self.memory: dict[str, float] = {"": math.nan}

    def evidence(self, column: pa.Array) -> np.ndarray:
        """(best, total, number) of each text's significant segments."""
        offsets, index, distinct = split(column)
        memory, token = self.memory, self.model.token
        if len(memory) > MEMORY:
            memory.clear()
            memory[""] = math.nan
        new = [p for p in distinct if p not in memory]
        for p in new:
            memory[p] = token(p)
        table = np.array([memory[p] for p in distinct], float)
        s = table[index] if len(index) else np.zeros(0)
        hot = np.concatenate([[0], np.cumsum(s > 0)])
        out = np.zeros((len(offsets) - 1, 3))
        for i in np.flatnonzero(hot[offsets[1:]] > hot[offsets[:-1]]).tolist():
            own = s[offsets[i] : offsets[i + 1]]
            out[i] = evidence(self.model, own[~np.isnan(own)])
        return out

    def probability(self, found: np.ndarray) -> np.ndarray:
        m = self.model
        z = m.curve[0] + np.log1p(found[:, :2]) @ np.array(m.curve[1:])
        return np.zeros(len(z)) if m.empty else 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, segments for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in slices(batches, "text"):
            found = reader.evidence(batch.column("text"))
            p = reader.probability(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(found[:, 2].astype(np.int32))], ["doc_id", "held_out", "score", "predicted", "segments"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("held_out", F.coalesce(_remainder() == HELD_OUT, F.lit(False)))
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, segments int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold; one pass, no shuffle or join. Only
    the texts go to Python, and a boolean comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(shared.value)
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            yield pa.array(np.concatenate([np.zeros(0, bool), *[reader.probability(reader.evidence(part.column("text"))) < threshold for part in slices([batch], "text")]]))

    return docs.where(clean(docs["text"].cast("string")))
