"""Skew-safe dense ordering within groups (no group is ever sorted by one task).

A window ``row_number() over (partition by g order by k)`` sends each group to a
single task; one group holding a third of all rows would then be one giant task.
Instead the rows are range-partitioned on (g, k) - a large group spans many
partitions - and sorted within partitions; that is the only shuffle. One pass over each
sorted partition then numbers the rows and the runs of each group it holds (Arrow batches,
numpy; a window would shuffle all rows again). What a partition must add to its first group is known from the
first and last rows of the partitions ahead: two narrow rows a partition, folded on the
driver and joined back by the partition's number.

The numbered rows are materialized (reliable checkpoint), so that the numbers are fixed
for every later use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize, staged


def _ranged(df: DataFrame, group: list[str], order: list[Column], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + list(order)
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def segment(df: DataFrame, group: list[str], order: list[Column], partitions: int | None = None) -> DataFrame:
    """Range-partition on (group, order), sort within partitions, tag ids, materialize: ``_pid`` is a row's
    partition, ``_mono`` rises with the order."""
    tagged = _ranged(df, group, order, partitions).withColumn("_mono", F.monotonically_increasing_id())
    return materialize(tagged).withColumn("_pid", F.shiftright("_mono", 33))


def _differing():
    """A function that tells which rows of a batch, from the second on, are unlike the one ahead in any of the columns; nulls
    are alike. It goes to the executors with the map that holds it."""
    def differs(batch, names):
        import numpy as np
        import pyarrow.compute as pc
        out = np.zeros(max(batch.num_rows - 1, 0), bool)
        for name in names:
            a, b = batch.column(name).slice(1), batch.column(name).slice(0, batch.num_rows - 1)
            unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            out |= unlike | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        return out
    return differs


def _numbering(group: list[str], kind: str | None):
    """A map over a sorted partition that adds _pid, _row (place in the group), _run (run in the group) and
    _end (1: the partition's first row, 2: its last, 3: both)."""
    differs = _differing()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        def at(batch, i):
            return [batch.column(g)[i].as_py() for g in group], batch.column(kind)[i].as_py() if kind else None

        part, held = TaskContext.get().partitionId(), None
        row = number = 0
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            first = at(batch, 0)
            fresh = last is None or first[0] != last[0]
            new_group = np.concatenate([[fresh], differs(batch, group)])
            new_run = np.concatenate([[fresh or first[1] != last[1]], differs(batch, [kind] if kind else [])]) | new_group
            i, so_far = np.arange(n), np.cumsum(new_run)
            start = np.maximum.accumulate(np.where(new_group, i, -1))
            inside = start >= 0
            rows = np.where(inside, i - start + 1, row + i + 1)
            runs = np.where(inside, so_far - so_far[np.maximum(start, 0)] + 1, number + so_far)
            row, number, last = int(rows[-1]), int(runs[-1]), at(batch, n - 1)
            ends = np.zeros(n, np.int32)
            ends[0] += held is None
            if held is not None:
                yield held[0]
            held = pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(rows), pa.array(runs), pa.array(ends)],
                                              [*batch.schema.names, "_pid", "_row", "_run", "_end"]), ends
        if held is not None:
            batch, ends = held
            ends[-1] += 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ends)], batch.schema.names)
    return run


def _numbered(df: DataFrame, group: list[str], order: list[Column], kind: str | None, partitions: int | None,
              write: Callable[[DataFrame], DataFrame] = materialize, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``_row`` and ``_run``, 1-based numbers within the group over all partitions."""
    spark = df.sparkSession
    schema = T.StructType([*df.drop(*drop).schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_row", T.LongType()),
                           T.StructField("_run", T.LongType()), T.StructField("_end", T.IntegerType())])
    tagged = write(_ranged(df, group, order, partitions).drop(*drop).mapInArrow(_numbering(group, kind), schema))
    kinds = [F.col(kind).alias("_kind")] if kind else [F.lit(None).cast("string").alias("_kind")]
    ends: dict[int, dict[int, object]] = {}
    # two rows of each partition
    for r in tagged.where("_end > 0").select("_pid", "_end", "_row", "_run", F.struct(*group).alias("_group"), *kinds).collect():
        for bit in (1, 2):
            if r["_end"] & bit:
                ends.setdefault(r["_pid"], {})[bit] = r
    carried, before, rows, runs = [], None, 0, 0
    for pid in sorted(ends):
        first, last = ends[pid][1], ends[pid][2]
        more = more_runs = 0
        if before is not None and before["_group"] == first["_group"]:
            more, more_runs = rows, runs - (before["_kind"] == first["_kind"])
            carried.append((pid, first["_group"], more, more_runs))
        goes_on = last["_group"] == first["_group"]
        before, rows, runs = last, last["_row"] + more * goes_on, last["_run"] + more_runs * goes_on
    tagged = tagged.drop("_end")
    if not carried:
        return tagged.drop("_pid")
    schema = T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_of", T.StructType([df.schema[g] for g in group])),
                           T.StructField("_rows", T.LongType()), T.StructField("_runs", T.LongType())])
    known = F.broadcast(spark.createDataFrame(carried, schema))  # a row for each partition that a group goes on in
    mine = F.struct(*group).eqNullSafe(F.col("_of"))
    return (tagged.join(known, "_pid", "left")
            .withColumns({"_row": F.col("_row") + F.when(mine, F.col("_rows")).otherwise(0), "_run": F.col("_run") + F.when(mine, F.col("_runs")).otherwise(0)})
            .drop("_pid", "_of", "_rows", "_runs"))


def dense_positions(df: DataFrame, group: list[str], order: list[Column], out: str = "pos",
                    partitions: int | None = None, write: Callable[[DataFrame], DataFrame] = materialize, drop: tuple[str, ...] = ()) -> DataFrame:
    """1-based dense position within ``group`` under the total order ``order``;
    equal to ``row_number()`` over the same window. ``group`` may be empty. ``write`` keeps the numbered rows, without the
    columns ``drop``, which only order them."""
    return _numbered(df, group, order, None, partitions, write, drop).withColumnRenamed("_row", out).drop("_run")


def positions_and_runs(df: DataFrame, group: list[str], order: list[Column], kind: str, pos: str = "pos",
                       run: str = "event_idx", partitions: int | None = None) -> DataFrame:
    """Dense positions plus gaps-and-islands run ids (0-based) on ``kind``:
    consecutive rows of equal kind share a run. Same result as ``row_number`` +
    ``lag`` + running sum over the group window, without that window."""
    marked = _numbered(df, group, order, kind, partitions)
    return marked.withColumnsRenamed({"_row": pos}).withColumn(run, F.col("_run") - 1).drop("_run")


def _summing(group: list[str], sums: list[str], out: list[str]):
    """A map over a sorted partition that replaces the columns ``sums`` by their running sums within the group. Of the rows
    those go on that have ``_kept``, and the partition's ends (``_end`` as in :func:`_numbering`)."""
    differs = _differing()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        def chosen(batch, values, kept, ends):
            batch = pa.RecordBatch.from_arrays([pa.array(values[c]) if c in values else batch.column(c) for c in out]
                                               + [pa.array(kept), pa.array(np.full(len(ends), part, np.int32)), pa.array(ends)], [*out, "_kept", "_pid", "_end"])
            return batch.filter(pa.array(kept | (ends > 0)))

        part, held, last = TaskContext.get().partitionId(), None, None
        so_far = dict.fromkeys(sums, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = last is None or [batch.column(g)[0].as_py() for g in group] != last
            start = np.maximum.accumulate(np.where(np.concatenate([[fresh], differs(batch, group)]), np.arange(n), -1))
            inside, at, values = start >= 0, np.maximum(start, 0), {}
            for c in sums:
                x = pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False)
                total = np.cumsum(x)
                values[c] = total + np.where(inside, x[at] - total[at], so_far[c])
                so_far[c] = int(values[c][-1])
            last = [batch.column(g)[n - 1].as_py() for g in group]
            kept = pc.fill_null(batch.column("_kept"), False).to_numpy(zero_copy_only=False)
            ends = np.zeros(n, np.int32)
            ends[0] += held is None
            if held is not None:
                yield chosen(*held)
            held = batch, values, kept, ends
        if held is not None:
            held[3][-1] += 2
            yield chosen(*held)
    return run


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], keep: Column,
                 partitions: int | None = None) -> DataFrame:
    """The rows of ``df`` where ``keep`` holds, with a running sum for each of ``sums`` (whole numbers, null as 0) over all rows of
    the group up to the row itself. Rows that are only counted go through the one shuffle and are not written."""
    rows = df.withColumns({c: x.cast("bigint") for c, x in sums.items()} | {"_kept": keep})
    out = [c for c in rows.columns if c != "_kept"]
    more = [T.StructField("_kept", T.BooleanType()), T.StructField("_pid", T.IntegerType()), T.StructField("_end", T.IntegerType())]
    schema = T.StructType([rows.schema[c] for c in out] + more)
    tagged = staged(_ranged(rows, group, order, partitions).mapInArrow(_summing(group, [*sums], out), schema))
    ends: dict[int, dict[int, object]] = {}
    # two rows of each partition
    for r in tagged.where("_end > 0").select("_pid", "_end", F.struct(*group).alias("_group"), *sums).collect():
        for bit in (1, 2):
            if r["_end"] & bit:
                ends.setdefault(r["_pid"], {})[bit] = r
    carried, before, total = [], None, [0] * len(sums)
    for pid in sorted(ends):
        first, last = ends[pid][1], ends[pid][2]
        ahead = total if before is not None and before["_group"] == first["_group"] else [0] * len(sums)
        if any(ahead):
            carried.append((pid, first["_group"], *ahead))
        goes_on = last["_group"] == first["_group"]
        before, total = last, [last[c] + x * goes_on for c, x in zip(sums, ahead)]
    found = tagged.where("_kept").drop("_kept", "_end")
    if not carried:
        return found.drop("_pid")
    schema = T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_of", T.StructType([df.schema[g] for g in group])),
                           *(T.StructField(f"_ahead_{c}", T.LongType()) for c in sums)])
    known = F.broadcast(df.sparkSession.createDataFrame(carried, schema))  # a row for each partition that a group goes on in
    mine = F.struct(*group).eqNullSafe(F.col("_of"))
    return (found.join(known, "_pid", "left")
            .withColumns({c: F.col(c) + F.when(mine, F.col(f"_ahead_{c}")).otherwise(0) for c in sums})
            .drop("_pid", "_of", *(f"_ahead_{c}" for c in sums)))


def _heading(group: list[str], run: str, value: str):
    """A map over a sorted partition that keeps the first row of each run, with ``ahead``, ``_nth`` (1 and 2: the partition's first and
    second run, else 0) and ``_last`` (the partition's last run)."""
    differs = _differing()

    def go(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        def at(batch, i, names):
            return [batch.column(c)[i].as_py() for c in names]

        part, seen, held, last, carry = TaskContext.get().partitionId(), 0, None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh_group = last is None or at(batch, 0, group) != last[:-1]
            new_group = np.concatenate([[fresh_group], differs(batch, group)])
            new_run = new_group | np.concatenate([[fresh_group or at(batch, 0, [run])[0] != last[-1]], differs(batch, [run])])
            last = at(batch, n - 1, [*group, run])
            i = np.flatnonzero(new_run)
            if not len(i):
                continue
            heads = batch.take(pa.array(i))
            values = heads.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ahead = pa.array(np.concatenate([[carry or 0], values[:-1]]), mask=new_group[i])
            carry = int(values[-1])
            nth = seen + 1 + np.arange(len(i))
            seen += len(i)
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays([*heads.columns, ahead, pa.array(np.full(len(i), part, np.int32)), pa.array(np.where(nth < 3, nth, 0).astype(np.int32)),
                                               pa.array(np.zeros(len(i), bool))], [*heads.schema.names, "ahead", "_pid", "_nth", "_last"])
        if held is not None:
            is_last = np.zeros(held.num_rows, bool)
            is_last[-1] = True
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(is_last)], held.schema.names)
    return go


def run_heads(df: DataFrame, group: list[str], run: str, order: list[Column], value: str, partitions: int | None = None) -> DataFrame:
    """The first row of each run, rows of a group that are neighbours in ``order`` and have the same ``run``, with ``ahead``: the
    ``value`` (a whole number) of the run's predecessor in the group, null for the group's first. ``order`` keeps runs together.

    One range shuffle and one pass, whatever the size of a group or run: what a partition's first and second run must know of
    those ahead is found from three narrow rows a partition."""
    schema = T.StructType([*df.schema.fields, T.StructField("ahead", T.LongType()), T.StructField("_pid", T.IntegerType()),
                           T.StructField("_nth", T.IntegerType()), T.StructField("_last", T.BooleanType())])
    tagged = staged(_ranged(df, group, order, partitions).mapInArrow(_heading(group, run, value), schema))
    edges: dict[int, dict[int, object]] = {}
    for r in tagged.where("_nth > 0 or _last").select("_pid", "_nth", "_last", F.struct(*group).alias("_group"), F.col(run).alias("_run"),
                                                      F.col(value).alias("_value")).collect():
        if r["_nth"]:
            edges.setdefault(r["_pid"], {})[r["_nth"]] = r
        if r["_last"]:
            edges.setdefault(r["_pid"], {})[0] = r
    known, before = [], None
    for pid in sorted(edges):
        first, second, last = edges[pid][1], edges[pid].get(2), edges[pid][0]
        if before is not None and before["_group"] == first["_group"]:
            if before["_run"] != first["_run"]:
                known.append((pid, 1, False, before["_value"]))
            else:  # the run goes on from an earlier partition
                known.append((pid, 1, True, None))
                if second is None:
                    continue
                if second["_group"] == first["_group"]:
                    known.append((pid, 2, False, before["_value"]))
        before = last
    tagged = tagged.drop("_last")
    if not known:
        return tagged.drop("_pid", "_nth")
    fixes = F.broadcast(df.sparkSession.createDataFrame(known, "_pid int, _nth int, _goes_on boolean, _ahead long"))
    return (tagged.join(fixes, ["_pid", "_nth"], "left").where(F.coalesce("_goes_on", F.lit(False)) == F.lit(False))
            .withColumn("ahead", F.coalesce("_ahead", "ahead")).drop("_pid", "_nth", "_goes_on", "_ahead"))
