"""Similar items (D20): the exact nearest neighbours of items by their vectors, with a clustered index.

Items are placed in the cell of their nearest pivot and stored in the order of (task, cell, distance to it), so that
stretches of the index lie in thin shells round a pivot. For a query and a stretch, the
distances to the pivots bound their own distance from below (triangle inequality): a stretch that can't
reach the query's k-th best neighbour so far is passed over, any other is measured exactly. Recall is
1 by construction; pivots, fitted on a bounded sample, only decide how much is passed over.

Scale: one range shuffle builds the index; queries are a stated set, taken in blocks of about
``max_queries`` that are broadcast and held against the index by one map over it, so no pair of items is ever a
row. A task keeps k rows a query, ranked by a grouped limit before and behind the shuffle.

Vectors are compared as whole numbers, ``floor(256 * x)``, by squared distance; ties by the neighbour's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

STRETCH = 64


def _pivots(items: DataFrame, n: int, sample_rows: int):
    """Of about ``sample_rows`` items one, then always that farthest from those chosen."""
    import numpy as np
    total = items.count()
    cut = min((1 << 63) - 1, (1 << 64) * sample_rows // max(1, total) - (1 << 63))
    rows = items.where(F.xxhash64("task", "item") <= F.lit(cut)).select("item", "numbers").limit(2 * sample_rows).toPandas().sort_values("item")
    if not len(rows):
        return None
    m = np.stack(rows["numbers"].to_list()).astype(np.float64)
    chosen = [0]
    nearest = ((m - m[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(m)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((m - m[chosen[-1]]) ** 2).sum(axis=1))
    return m[chosen]


def _placing(pivots):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            n = batch.num_rows
            m = batch.column(2).flatten().to_numpy().reshape(n, -1).astype(np.float64) if n else np.zeros((0, pivots.shape[1]))
            far = np.sqrt(np.maximum(0, (m ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * m @ pivots.T))
            cell = far.argmin(axis=1) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(far), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)),
                                              pa.array(far[np.arange(n), cell])], ["task", "item", "numbers", "far", "cell", "near"])
    return run


def _searching(queries, k: int, stretch: int):
    """A map over the index: the k nearest other items of its task to each query of the block, in a partition."""
    def run(batches):
        import heapq

        import numpy as np
        import pyarrow as pa
        tasks, names, m, far = queries.value
        square = (m ** 2).sum(axis=1)
        best: list[list] = [[] for _ in names]  # heaps of (-distance, reversed name)
        worst = np.full(len(names), np.inf)

        class Later(str):
            """Names in reverse order: a heap drops the greatest of equal distances first."""
            def __lt__(self, other):
                return str.__gt__(self, other)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of, items = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = batch.column(2).flatten().to_numpy().reshape(n, -1).astype(np.float64)
            shells = batch.column(3).flatten().to_numpy().reshape(n, -1)
            for at in range(0, n, stretch):
                to = min(at + stretch, n)
                lo, hi = shells[at:to].min(axis=0), shells[at:to].max(axis=0)
                least = np.maximum(np.maximum(far - hi, lo - far), 0).max(axis=1)
                here = {t: [i for i in range(at, to) if of[i] == t] for t in set(of[at:to])}
                for task, mine in here.items():
                    ask = np.flatnonzero((tasks == task) & ((least * (1 - 1e-9) - 1e-3) ** 2 * (least > 1e-3) <= worst))
                    if not len(ask):
                        continue
                    found = square[ask][:, None] + (rows[mine] ** 2).sum(axis=1) - 2 * m[ask] @ rows[mine].T
                    for a, j in zip(*np.nonzero(found <= worst[ask][:, None])):
                        q, name = ask[a], items[mine[j]]
                        if name == names[q]:
                            continue
                        heap = best[q]
                        heapq.heappush(heap, (-found[a, j], Later(name)))
                        if len(heap) > k:
                            heapq.heappop(heap)
                        if len(heap) == k:
                            worst[q] = -heap[0][0]
        flat = [(q, -d, str(name)) for q, heap in enumerate(best) for d, name in heap]
        yield pa.RecordBatch.from_arrays([pa.array([tasks[q] for q, _, _ in flat], pa.string()), pa.array([names[q] for q, _, _ in flat], pa.string()),
                                          pa.array([n for _, _, n in flat], pa.string()), pa.array([int(d) for _, d, _ in flat], pa.int64())],
                                         ["task", "item", "neighbour", "distance"])
    return run


def nearest_items(items: DataFrame, queries: DataFrame | None = None, k: int = 5, n_pivots: int = 32, sample_rows: int = 4096,
                  max_queries: int = 8192, stretch: int = STRETCH) -> DataFrame:
    """(task, item, neighbour, distance, rank): the k nearest other items of its task to each item of ``queries``
    (task, item; all items if None). ``items``: (task, item, vector), vectors of one length.

    Items with a null name or vector, or a null or non-finite component, take no part; repeated (task, item) count
    once, with the smallest vector."""
    import numpy as np
    context = items.sparkSession.sparkContext
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(1 << 16))))
    known = (items.where(F.col("task").isNotNull() & F.col("item").isNotNull() & F.col("vector").isNotNull()).where(fine)
             .select("task", "item", F.transform("vector", lambda x: F.floor(x.cast("double") * 256)).alias("numbers"))
             .groupBy("task", "item").agg(F.min("numbers").alias("numbers")))
    known = materialize(known)
    empty = items.sparkSession.createDataFrame([], "task string, item string, neighbour string, distance long, rank int")
    pivots = _pivots(known, n_pivots, sample_rows)
    if pivots is None:
        return empty
    index = known.mapInArrow(_placing(pivots), "task string, item string, numbers array<bigint>, far array<double>, cell int, near double")
    index = materialize(index.repartitionByRange("task", "cell", "near", "item").sortWithinPartitions("task", "cell", "near", "item"))
    asked = index.select("task", "item", "numbers", "far")
    if queries is not None:
        asked = asked.join(queries.select("task", "item").distinct(), ["task", "item"], "left_semi")
    asked = materialize(asked)
    n_blocks = -(-asked.count() // max_queries)
    out = empty
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("task", "item"), F.lit(n_blocks)) == b).toPandas()
        if not len(block):
            continue
        held = context.broadcast((block["task"].to_numpy(), block["item"].to_list(), np.stack(block["numbers"].to_list()).astype(np.float64),
                                  np.stack(block["far"].to_list())))
        found = index.mapInArrow(_searching(held, k, stretch), "task string, item string, neighbour string, distance bigint")
        w = Window.partitionBy("task", "item").orderBy("distance", "neighbour")
        out = out.unionByName(materialize(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)))
    return out
