"""Hard-negative mining: for each anchor and positive, near rows of another label whose score lies in a window.

Components become whole numbers, ``floor(scale * x)``; a score is the integer inner product
with the anchor, higher first, ties by smaller id. An anchor's positives are its first
``n_positives`` other rows of its label; a positive's negatives are the first ``n_negatives``
rows of other labels with ``low * positive <= 100 * negative <= high * positive``.

Scores are found by angular triangle filtering. Every row stores its angles to a few
reference directions. For an anchor at angle u and a row at angle v to one direction, their
own angle lies between |u - v| and min(u + v, 2 pi - u - v); the narrowest interval over
all directions, taken as cosines and multiplied by both norms, is widened by more than
rounding can take and gives bounds of the score. Rows are ordered by nearest direction
and angle, so a short stretch of rows has narrow angles: a stretch whose bounds miss what an anchor still looks for (its
positives: at least the worst score kept; its negatives: the score windows of its positives)
is passed over for that anchor, and only the stretches that overlap are scored, in integers.
Vectors that point everywhere alike leave little to pass over: the result is the same, the work then is that of scoring
all rows in blocks.

Scale: the index (one row of numbers and angles each) is made by one range shuffle that
splits any number of like or equal vectors. Anchors are a query set that grows with the input:
they are taken in blocks of about ``max_anchors`` by a hash, each block broadcast and held against
the whole index by one map over it, so memory is bounded by the block. Each task keeps the best few rows an anchor
and window; these are ranked by a grouped limit before and behind the shuffle. Directions are fitted on a bounded
hash sample (``sample_rows``) by choosing rows far from each other; they decide what can be passed over, never the result.

Defined results: rows with a null id, label or vector, or a null or non-finite component,
take no part, nor do rows so long that a score might not fit into 64 bits (an integer norm
of 2**30 or more); shorter vectors count as filled with zeros; rows equal in id, label and
numbers are one row; rows of one id that differ are rows of their own; an empty vector scores
zero with all; an empty table, or one without anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hash_sample, ship
from tidemark.session import materialize

STRETCH = 128  # rows that share bounds
SLACK = 1e-6  # radians by which every interval is widened; a stored angle (32 bits, arccos of a rounded cosine) is off by less than 2e-7
TOO_LONG = 1 << 30
EXACT = 2.0 ** 52  # below it, floating-point sums of whole numbers are exact
LONG = T.LongType()
INDEX = T.StructType([
    T.StructField("vec_id", LONG), T.StructField("label", LONG), T.StructField("is_anchor", T.BooleanType()),
    T.StructField("numbers", T.BinaryType()), T.StructField("norm", T.DoubleType()), T.StructField("angles", T.ArrayType(T.FloatType())),
    T.StructField("cell", T.IntegerType()), T.StructField("angle", T.FloatType())])
BEST = T.StructType([T.StructField(x, LONG) for x in ("anchor", "anchor_id", "window", "score", "vec_id")])
MINED = T.StructType([T.StructField("anchor_id", LONG), T.StructField("positive_id", LONG), T.StructField("rank", T.IntegerType()),
                      T.StructField("negative_id", LONG), T.StructField("positive_score", LONG), T.StructField("negative_score", LONG)])


def _taking_part(rows: DataFrame, is_anchor: Column, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, is_anchor, numbers): whole numbers as doubles, of the rows that take part."""
    def fine(x):
        scaled = F.abs(x.cast("double") * scale)
        return x.isNotNull() & ~F.isnan(scaled) & (scaled < TOO_LONG)

    some = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.col(vector_col).alias("vector"))
    return (some.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine))
            .select("vec_id", "label", "is_anchor", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("numbers")))


def _matrix(vectors: list, dims: int) -> np.ndarray:
    """The vectors as rows of ``dims`` numbers, filled with zeros."""
    sizes = np.array([len(v) for v in vectors], np.int64)
    out = np.zeros((len(vectors), dims))
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        out[at, :size] = np.stack([vectors[i] for i in at])
    return out


def _from_lists(lists: pa.Array) -> np.ndarray:
    """The same for an Arrow array of lists, as wide as the longest."""
    offsets = lists.offsets.to_numpy()
    values, offsets = lists.values.to_numpy(zero_copy_only=False), offsets[:len(lists) + 1]
    return _matrix([values[i:j] for i, j in zip(offsets[:-1], offsets[1:])], int(np.diff(offsets).max(initial=1)))


def reference_directions(rows: DataFrame, n: int = 16, sample_rows: int = 4096) -> np.ndarray:
    """Unit vectors: of about ``sample_rows`` rows, one, then always that farthest from those chosen."""
    sample = hash_sample(rows, sample_rows, "vec_id", "numbers").select("vec_id", "numbers").limit(sample_rows).toPandas().sort_values("vec_id")
    vectors = list(sample["numbers"])
    m = _matrix(vectors, max([1, *map(len, vectors)]))
    norms = np.linalg.norm(m, axis=1)
    m = m[norms > 0] / norms[norms > 0, None]
    if not len(m):
        return np.ones((1, 1))
    chosen, nearest = [0], m @ m[0]
    while len(chosen) < min(n, len(m)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, m @ m[chosen[-1]])
    return m[chosen]


def _angles(m: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles to the directions; a zero vector is at right angles to all."""
    d = np.zeros((len(directions), max(m.shape[1], directions.shape[1])))
    d[:, :directions.shape[1]] = directions
    unit = m / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(unit @ d[:, :m.shape[1]].T, -1, 1))


def build_index(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """The rows with numbers, norm and angles, range-partitioned by nearest direction, angle and id, and written."""
    def run(batches):
        for batch in batches:
            m = _from_lists(batch.column(3))
            norms = np.linalg.norm(m, axis=1)
            keep = np.flatnonzero(norms < TOO_LONG)
            angles = _angles(m[keep], norms[keep], directions).astype(np.float32)
            cell = angles.argmin(axis=1).astype(np.int32)
            rest = batch.select([0, 1, 2]).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array([np.trim_zeros(m[i], "b").astype("<i4").tobytes() for i in keep], pa.binary()),
                 pa.array(norms[keep]), pa.array(list(angles), pa.list_(pa.float32())), pa.array(cell),
                 pa.array(angles[np.arange(len(keep)), cell])], INDEX.names)

    index = rows.mapInArrow(run, INDEX)
    return materialize(index.repartitionByRange("cell", "angle", "vec_id", "label")
                       .sortWithinPartitions("cell", "angle", "vec_id", "label", "numbers"))


class Rows:
    """Some rows of the index as arrays."""

    def __init__(self, columns: dict, dims: int):
        self.ids = np.asarray(columns["vec_id"], np.int64)
        self.labels = np.asarray(columns["label"], np.int64)
        self.raw = columns["numbers"]
        self.norms = np.asarray(columns["norm"], np.float64)
        self.angles = np.asarray(columns["angles"], np.float64)
        self.m = _matrix([np.frombuffer(b, "<i4")[:dims] for b in self.raw], dims)

    @classmethod
    def of_batch(cls, batch: pa.RecordBatch, dims: int) -> "Rows":
        columns = {c: batch.column(c).to_numpy() for c in ("vec_id", "label", "norm")}
        return cls(columns | {"numbers": batch.column("numbers").to_pylist(), "angles": _from_lists(batch.column("angles"))}, dims)

    def scores(self, i: np.ndarray, other: "Rows", j: np.ndarray) -> np.ndarray:
        """Integer inner products of the rows i with the other's rows j."""
        a, b = self.m[i], other.m[j]
        if self.norms[i].max(initial=0) * other.norms[j].max(initial=0) < EXACT:
            return (a @ b.T).astype(np.int64)
        return a.astype(np.int64) @ b.astype(np.int64).T


def _bounds(least: np.ndarray, most: np.ndarray, short: np.ndarray, long: np.ndarray, anchors: Rows):
    """Lower and upper bounds (anchor x stretch) of the scores with rows whose angles and norms lie in the given ranges."""
    apart, near = np.zeros((len(anchors.ids), len(short))), np.full((len(anchors.ids), len(short)), math.pi)
    for r in range(least.shape[1]):
        u = anchors.angles[:, r, None]
        np.maximum(apart, np.maximum(u - most[None, :, r], least[None, :, r] - u), out=apart)
        around = np.minimum(u + most[None, :, r], 2 * math.pi - u - least[None, :, r])
        np.minimum(near, np.maximum(around, 0), out=near)
    high = np.cos(np.clip(apart - SLACK, 0, math.pi))
    low = np.cos(np.clip(near + SLACK, 0, math.pi))
    norms = anchors.norms[:, None]
    high = norms * np.where(high > 0, long, short) * high
    low = norms * np.where(low > 0, short, long) * low
    return np.floor(low - 1 - 1e-9 * np.abs(low)), np.ceil(high + 1 + 1e-9 * np.abs(high))


class _Best:
    """The best few rows of every (anchor, window), by score, then smaller id."""

    def __init__(self, n_keys: int, n: int):
        self.n, self.worst = n, np.full(n_keys, -(1 << 62), np.int64)
        self.parts, self.size, self.kept = [], 0, 0

    def add(self, keys, scores, ids):
        self.parts.append(np.stack([keys, scores, ids]))
        self.size += len(keys)
        if self.size > 2 * self.kept + (1 << 16):
            self.shrink()

    def shrink(self) -> np.ndarray:
        all_ = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((3, 0), np.int64)
        all_ = all_[:, np.lexsort((all_[2], -all_[1], all_[0]))]
        first = np.flatnonzero(np.diff(all_[0], prepend=-1))
        place = np.arange(all_.shape[1]) - np.repeat(first, np.diff(first, append=all_.shape[1]))
        last = place == self.n - 1
        self.worst[all_[0, last]] = all_[1, last]
        all_ = all_[:, place < self.n]
        self.parts, self.size, self.kept = [all_], all_.shape[1], all_.shape[1]
        return all_


def _search(anchors: Rows, windows: np.ndarray | None, n: int, dims: int):
    """A map over the index: the best ``n`` rows of every (anchor, window) in a partition.

    windows: None for the other rows of the anchor's label; else (anchors, k, 2) least and greatest scores
    for rows of other labels, empty where least > greatest.
    """
    k = 1 if windows is None else windows.shape[1]

    def run(batches):
        best, last = _Best(len(anchors.ids) * k, n), None
        for batch in batches:
            rows = Rows.of_batch(batch, dims)
            new = np.ones(len(rows.ids), bool)  # not as the row before
            for i, this in enumerate(zip(rows.ids, rows.labels, rows.raw)):
                new[i], last = this != last, this
            cuts = np.arange(0, len(rows.ids), STRETCH)
            if not len(cuts):
                continue
            low, high = _bounds(np.minimum.reduceat(rows.angles, cuts), np.maximum.reduceat(rows.angles, cuts),
                                np.minimum.reduceat(rows.norms, cuts), np.maximum.reduceat(rows.norms, cuts), anchors)
            for c, at in enumerate(cuts):
                of = np.flatnonzero(_wanted(low[:, c], high[:, c], windows, best.worst.reshape(-1, k)))
                if len(of):
                    _score(of, np.arange(at, min(at + STRETCH, len(rows.ids))), new, rows, anchors, windows, best)
        found = best.shrink()
        anchor = found[0] // k
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, anchors.ids[anchor], found[0] % k, found[1], found[2])], BEST.names)
    return run


def _wanted(low: np.ndarray, high: np.ndarray, windows: np.ndarray | None, worst: np.ndarray) -> np.ndarray:
    """The anchors that still look for scores between their bounds."""
    if windows is None:
        return high >= worst[:, 0]
    least, most = np.maximum(windows[:, :, 0], worst), windows[:, :, 1]
    return ((least <= most) & (least <= high[:, None]) & (low[:, None] <= most)).any(axis=1)


def _score(of: np.ndarray, at: np.ndarray, new: np.ndarray, rows: Rows, anchors: Rows, windows: np.ndarray | None, best: _Best) -> None:
    """Integer scores of the anchors ``of`` with the rows ``at``; those looked for go to ``best``."""
    k = 1 if windows is None else windows.shape[1]
    worst = best.worst.reshape(-1, k)
    scores = anchors.scores(of, rows, at)
    other = anchors.labels[of, None] != rows.labels[None, at]
    if windows is None:
        a, r = np.nonzero(~other & new[None, at] & (scores >= worst[of]))
        own = anchors.ids[of[a]] == rows.ids[at[r]]
        own[own] = [anchors.raw[x] == rows.raw[y] for x, y in zip(of[a[own]], at[r[own]])]
        a, r = a[~own], r[~own]
        best.add(of[a], scores[a, r], rows.ids[at[r]])
        return
    other &= new[None, at]
    for w in range(k):
        least, most = np.maximum(windows[of, w, 0], worst[of, w]), windows[of, w, 1]
        a, r = np.nonzero(other & (scores >= least[:, None]) & (scores <= most[:, None]))
        best.add(of[a] * k + w, scores[a, r], rows.ids[at[r]])


def _ranked(found: DataFrame, n: int) -> DataFrame:
    """``found`` with its rank per (anchor, window), up to n."""
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mine(rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         scale: int = 256, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
         max_anchors: int = 16384, n_directions: int = 16, sample_rows: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see the module's text.

    is_anchor and label are expressions over ``rows``; low and high are percentages of the positive's score.
    """
    spark = rows.sparkSession
    ship(spark)
    part = _taking_part(rows, is_anchor, label, id_col, vector_col, scale)
    index = build_index(part, reference_directions(part, n_directions, sample_rows))
    chosen = index.where("is_anchor").select("vec_id", "label", "numbers", "norm", "angles").dropDuplicates(["vec_id", "label", "numbers"])
    chosen = materialize(chosen)
    n_blocks = -(-chosen.count() // max_anchors)
    mined = spark.createDataFrame([], MINED)
    for block in range(n_blocks):
        key = F.pmod(F.xxhash64("vec_id", "label", "numbers"), F.lit(n_blocks))
        held = chosen.where(key == block).toPandas().sort_values(["vec_id", "label", "numbers"])
        if len(held):
            mined = mined.unionByName(_mine_block(index, held, n_positives, n_negatives, low, high))
    return mined


def _mine_block(index: DataFrame, held, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    """The rows of one block of anchors, ``held`` (a pandas frame of index rows)."""
    context = index.sparkSession.sparkContext
    dims = max(1, max(map(len, held["numbers"])) // 4)
    columns = {c: list(held[c]) for c in held.columns}
    anchors = context.broadcast(Rows(columns | {"angles": np.stack(columns["angles"])}, dims))
    positives = materialize(_ranked(index.mapInArrow(lambda b: _search(anchors.value, None, n_positives, dims)(b), BEST), n_positives))
    windows = np.zeros((len(held), n_positives, 2), np.int64)
    windows[:, :, 0] = 1  # empty
    for r in positives.select("anchor", "rank", "score").toLocalIterator():
        windows[r.anchor, r.rank - 1] = -(-low * r.score // 100), high * r.score // 100
    wanted = context.broadcast(windows)
    negatives = materialize(_ranked(index.mapInArrow(lambda b: _search(anchors.value, wanted.value, n_negatives, dims)(b), BEST), n_negatives))
    pairs = positives.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"),
                             F.col("score").alias("positive_score"))
    return (negatives.join(pairs, ["anchor", "window"])
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
