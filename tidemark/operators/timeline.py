"""B family: order raw rows into one timeline per subject, then group runs into events.

No group is ever sorted by one task: positions come from a range-partitioned order (see
``operators.ordering``), runs from blocks of consecutive positions whose ends are
combined, and events from partial aggregates by (subject, run). A subject with a third of all rows is
spread like any other data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import dense_positions, positions_and_runs
from tidemark.session import materialize
from tidemark.spec import DEFAULT, DEMOGRAPHICS_KIND, UNTIMED_KINDS, TimelineSpec

BLOCK_ROWS = 4096

# tail ranks for rows placed after their visit's last timed row
_TAIL = {"diagnoses_icd": 1, "drgcodes": 2}


def order_within(df: DataFrame, partition: list[str], order: list, pos_col: str = "pos",
                 write: Callable[[DataFrame], DataFrame] = materialize, drop: tuple[str, ...] = ()) -> DataFrame:
    """Generic B1-B4 helper: dense position per partition under a total order. ``write`` and ``drop`` as in :func:`dense_positions`."""
    return dense_positions(df, list(partition), [F.col(c) if isinstance(c, str) else c for c in order], pos_col, write=write, drop=drop)


def _placed(rows: DataFrame, s: TimelineSpec) -> tuple[DataFrame, list]:
    """Rows with their place, and the order of places in a subject (B5-B8):

    * demographics rows first (B8);
    * timed rows by (time, source rank, kind, row key) (B5);
    * ``diagnoses_icd`` right after the last timed row of its visit, ``drgcodes``
      after those (B6); untimed rows without a timed row in their visit, and
      timed-kind rows whose time is missing, go once to the end (B7, deliberate).

    The untimed-row anchor is an aggregate per (subject, visit), joined back with a NULL-safe visit match."""
    t, kind = F.col(s.time_us), F.col(s.kind)
    is_demo = kind == F.lit(DEMOGRAPHICS_KIND)
    timed = t.isNotNull() & ~kind.isin(*UNTIMED_KINDS)
    sort_key = F.struct(t.alias("t"), F.col(s.source_rank).alias("sr"), kind.alias("k"), F.col(s.row_key).alias("r"))
    anchors = (rows.where(timed).groupBy(s.subject, s.visit).agg(F.max(sort_key).alias("_va"))
               .withColumnRenamed(s.subject, "_as").withColumnRenamed(s.visit, "_av"))
    tail = F.coalesce(*[F.when(kind == F.lit(k), F.lit(v)) for k, v in _TAIL.items()], F.lit(3))
    # only the kinds that follow their visit look for it
    follow = rows.where(kind.isin(*_TAIL))
    found = follow.join(anchors, (F.col(s.subject) == F.col("_as")) & F.col(s.visit).eqNullSafe(F.col("_av")), "left").drop("_as", "_av")
    other = rows.where(~F.coalesce(kind.isin(*_TAIL), F.lit(False))).withColumn("_va", F.lit(None).cast(anchors.schema["_va"].dataType))
    placed = (found.unionByName(other)
              .withColumn("_anchor", F.when(timed, sort_key).otherwise(F.col("_va")))
              .withColumn("_grp", F.when(is_demo, F.lit(0)).when(F.col("_anchor").isNotNull(), F.lit(1)).otherwise(F.lit(2)))
              .withColumn("_tail", F.when(timed, F.lit(0)).otherwise(tail))
              .drop("_va"))
    return placed, [F.col("_grp"), F.col("_anchor.t"), F.col("_anchor.sr"), F.col("_anchor.k"), F.col("_anchor.r"),
                    F.col("_tail"), F.col(s.row_key), kind]


def order_timeline(rows: DataFrame, spec: TimelineSpec = DEFAULT, partitions: int | None = None) -> DataFrame:
    """One total order per subject, exposed as ``pos`` (1-based)."""
    placed, order = _placed(rows, spec)
    return dense_positions(placed, [spec.subject], order, spec.pos, partitions).drop("_anchor", "_grp", "_tail")


def order_and_mark(rows: DataFrame, spec: TimelineSpec = DEFAULT, partitions: int | None = None) -> DataFrame:
    """B5-B9 in one go: same ``pos`` and ``event_idx`` as :func:`order_timeline`, then :func:`mark_runs`."""
    placed, order = _placed(rows, spec)
    return positions_and_runs(placed, [spec.subject], order, spec.kind, spec.pos, spec.event_idx, partitions).drop("_anchor", "_grp", "_tail")


def mark_runs(timeline: DataFrame, spec: TimelineSpec = DEFAULT, split_on_visit: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """B9 gaps-and-islands: consecutive rows of equal kind share ``event_idx`` (0-based).

    The key is the kind only (a run may cross time and visit boundaries), unless ``split_on_visit``.
    Positions are dense, so blocks of ``block_rows`` of them are marked by themselves; a block's first row
    and number of runs then wait for what the blocks ahead of it end with."""
    s = spec
    key = F.struct(s.kind, s.visit) if split_on_visit else F.struct(s.kind)
    rows = timeline.withColumns({"_block": F.floor(F.col(s.pos) / block_rows), "_run_of": key})
    w = Window.partitionBy(s.subject, "_block").orderBy(s.pos)
    before = F.lag("_run_of").over(w)
    rows = rows.withColumn("_new", F.when(before.isNull() | before.eqNullSafe(F.col("_run_of")), 0).otherwise(1))
    blocks = rows.groupBy(s.subject, "_block").agg(F.sum("_new").alias("_n"), F.min_by("_run_of", s.pos).alias("_f"), F.max_by("_run_of", s.pos).alias("_l"))
    ws = Window.partitionBy(s.subject).orderBy("_block")
    ahead = F.lag("_l").over(ws)
    blocks = blocks.withColumn("_starts", F.when(ahead.isNotNull() & ahead.eqNullSafe(F.col("_f")), 0).otherwise(1))
    upto = F.sum(F.col("_n") + F.col("_starts")).over(ws.rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.select(s.subject, "_block", (upto - F.col("_n") - 1).alias("_first"))
    inside = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (rows.join(blocks, [s.subject, "_block"]).withColumn(s.event_idx, (F.col("_first") + inside).cast("bigint"))
            .drop("_block", "_run_of", "_new", "_first"))


def eventize(timeline: DataFrame, spec: TimelineSpec = DEFAULT, extra_first: tuple[str, ...] = (),
             split_on_visit: bool = False, marked: bool = False) -> DataFrame:
    """One row per event (run) with times, visit, item count.

    ``starttime`` = time of the first row, else the first non-null time; ``endtime`` =
    max time; both NULL for demographics/diagnoses/drg. The visit is the first row's.
    ``extra_first`` columns are taken from the run's first row (the reference's
    ``items[0]``). Items themselves stay in the row table (see :func:`run_items`).
    ``marked=True`` means the input already carries ``event_idx`` (:func:`mark_runs`).
    """
    s = spec
    # rows with run ids are combined before they are shuffled, by (subject, run): a
    # subject with a third of the rows is not brought to one task
    marked = timeline if marked else mark_runs(timeline, s, split_on_visit)
    pos = F.col(s.pos)
    t = F.col(s.time_us)
    first = lambda c: F.min_by(F.col(c), pos)
    aggs = [
        first(s.kind).alias(s.kind),
        first(s.visit).alias(s.visit),
        F.coalesce(first(s.time_us), F.min_by(t, F.when(t.isNotNull(), pos))).alias("_start"),
        F.max(t).alias("_end"),
        F.count(F.lit(1)).alias("n_items"),
        F.min(pos).alias("first_pos"),
    ] + [first(c).alias(c) for c in extra_first]
    ev = marked.groupBy(s.subject, s.event_idx).agg(*aggs)
    untimed = F.col(s.kind).isin(*UNTIMED_KINDS)
    return (ev.withColumn(s.start_us, F.when(~untimed, F.col("_start")))
            .withColumn(s.end_us, F.when(~untimed, F.col("_end")))
            .drop("_start", "_end"))


def run_items(timeline: DataFrame, value_cols: list[str], spec: TimelineSpec = DEFAULT,
              marked: bool = False) -> DataFrame:
    """The ordered item list of every event, ``array<struct>`` sorted by position.
    ``marked=True``: the input already carries ``event_idx``."""
    s = spec
    marked = timeline if marked else mark_runs(timeline, s)
    item = F.struct(F.col(s.pos).alias("pos"), *[F.col(c) for c in value_cols])
    return (marked.groupBy(s.subject, s.event_idx)
            .agg(F.array_sort(F.collect_list(item)).alias(s.items)))


def event_count_filter(events: DataFrame, lo: int = 1, hi: int = 1200, spec: TimelineSpec = DEFAULT) -> DataFrame:
    """Keep subjects whose event count is within [lo, hi] (partial count per
    partition, then a semi join on the small per-subject table)."""
    s = spec
    n = events.groupBy(s.subject).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(lo, hi))
    return events.join(n.select(s.subject), s.subject, "left_semi")


def merge_stays(rows: DataFrame, visit: str, stay: str, root_kind: str, kind: str = "file_name",
                order: str = "pos", payload: list[str] | None = None) -> DataFrame:
    """One nested record per (visit, stay): the stay row plus its sub rows."""
    payload = payload or []
    is_root = F.col(kind) == F.lit(root_kind)
    sub = F.struct(F.col(order).alias("pos"), F.col(kind).alias("kind"), *[F.col(c) for c in payload])
    return (rows.groupBy(visit, stay)
            .agg(F.min_by(F.struct(*[F.col(c) for c in [order] + payload]), F.when(is_root, F.col(order))).alias("stay"),
                 F.array_sort(F.collect_list(F.when(~is_root, sub))).alias("sub_rows")))


# ---------------------------------------------------------------------------
# Per-source orderings (B1-B4). ED kind ranks.
# ---------------------------------------------------------------------------
ED_KIND_RANK = {"edstays": 0, "triage": 1, "medrecon": 2, "pyxis": 3, "vitalsign": 4, "diagnosis": 5}


def _rank_expr(col, mapping: dict, default: int = 99):
    expr = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        expr = F.when(col == F.lit(k), F.lit(v)).otherwise(expr)
    return expr


def order_notes(notes: DataFrame, subject: str = "subject_id", time_us: str = "ts_us",
                note_seq: str = "note_seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """B1: notes of a subject by (charttime, note_seq)."""
    return order_within(notes, [subject], [F.col(time_us), F.col(note_seq), *[F.col(k) for k in keys]])


def synth_ed_times(rows: DataFrame, stays: DataFrame, stay: str = "stay_id", kind: str = "file_name",
                   time_us: str = "ts_us", intime: str = "intime_us", outtime: str = "outtime_us") -> DataFrame:
    """Triage time = stay intime + 1 s; ED diagnosis time = stay outtime.

    ``stays`` is one row per stay; it is joined on ``stay`` (shuffle or size-checked
    broadcast, chosen by Catalyst/AQE)."""
    s = stays.select(stay, intime, outtime)
    j = rows.join(s, stay, "left")
    t = (F.when(F.col(kind) == "triage", F.col(intime) + F.lit(1_000_000))
         .when(F.col(kind) == "diagnosis", F.col(outtime))
         .otherwise(F.col(time_us)))
    return j.withColumn(time_us, t).drop(intime, outtime)


def order_ed(rows: DataFrame, subject: str = "subject_id", stay: str = "stay_id", kind: str = "file_name",
             time_us: str = "ts_us", keys: tuple[str, ...] = ()) -> DataFrame:
    """B2: by (stay, phase, time, kind rank): edstays/triage first, diagnosis last."""
    k = F.col(kind)
    phase = F.when(k.isin("edstays", "triage"), F.lit(0)).when(k == "diagnosis", F.lit(2)).otherwise(F.lit(1))
    t = F.when(phase == 1, F.col(time_us))
    return order_within(rows, [subject], [F.col(stay), phase, t, _rank_expr(k, ED_KIND_RANK), *[F.col(c) for c in keys]])


def order_icu(rows: DataFrame, subject: str = "subject_id", visit: str = "hadm_id", stay: str = "stay_id",
              kind: str = "file_name", time_us: str = "ts_us", keys: tuple[str, ...] = ()) -> DataFrame:
    """By (visit, stay, stay row first, time)."""
    is_stay = (F.col(kind) == "icustays").cast("int")
    return order_within(rows, [subject], [F.col(visit), F.col(stay), -is_stay,
                                          F.col(time_us), *[F.col(c) for c in keys]])
