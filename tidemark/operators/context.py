"""C family: time-bounded contexts, next/last-of-kind and as-of links over the events of a subject of any size.

A subject's events are numbered densely, so ``event_idx div block_events`` cuts them into blocks
of at most ``block_events`` rows, and (subject, block) is a key that no hot subject outgrows. Every column is a scan in
two levels:

* inside a block, windows keyed by (subject, block[, visit]): one exchange for all of them;
* between blocks, a summary row per (subject, block) and per (subject, block, visit): first and last
  event of a kind, last start, last timed event. Summaries are combined over the blocks of a subject
  (one row for ``block_events`` events) and come back as one carried row per block, with a map for
  the visits that reach beyond it.

Contexts bounded by time (24 hours back and on, the end of a stay) can reach any number of blocks. Where an event's bound lies in
another block, a probe is put at the bound into the time order of the subject (and visit) and
takes the neighbouring event there: rows and probes are range-partitioned and the neighbour is carried
over partition ends (:func:`neighbours`), so a crowded day is spread as well. Only subjects with
more than one block take part in what lies between blocks; ordinary subjects pay one exchange.

Precondition shared with the reference: start times are non-decreasing in ``event_idx`` (NULL
times aside), which the timeline order guarantees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.time import US_PER_HOUR
from tidemark.operators.ordering import segment
from tidemark.session import materialize

BLOCK_EVENTS = 4096
DAY_US = 24 * US_PER_HOUR
_KEY = ["subject_id", "block"]
_AT = T.StructType([T.StructField("i", T.LongType()), T.StructField("t", T.LongType())])
_ONE = {"next": T.StructType([T.StructField("next", T.LongType())]), "prev": T.StructType([T.StructField("prev", _AT)])}
_ASOF = T.StructType([T.StructField("i", T.LongType()), T.StructField("v", T.LongType())])
#: What the other blocks hold for a block, by column.
_CARRIED = {"x_dod": T.LongType(), "x_prev_start": T.LongType(), "x_latest": T.LongType(), "x_earliest": T.LongType(), "x_ed": _AT, "x_adm": _AT,
            "x_adm_asof": _ASOF, "x_dis_asof": _ASOF,
            "x_visits": T.MapType(T.LongType(), T.StructType([T.StructField(a, _AT) for a in ("adm", "icu", "timed")])),
            "x_far": T.MapType(T.LongType(), T.StructType([T.StructField("back", _ONE["next"]), T.StructField("on", _ONE["prev"]), T.StructField("until", _ONE["prev"])]))}
_PAST, _TO_COME = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, -1)


def neighbours(rows: DataFrame, group: list[str], order: list[Column], before: Column, after: Column,
               partitions: int | None = None) -> DataFrame:
    """``rows`` with ``prev``, the last non-null ``before`` of the rows ahead in its group's order, and ``next``,
    the first non-null ``after`` of those behind. No group is gathered: rows are range-partitioned, and one
    value per (group, partition) is carried over partition ends."""
    tagged = segment(rows.withColumns({"_before": before, "_after": after}), group, order, partitions)
    some = F.col("_mono")
    ends = tagged.groupBy(*group, "_pid").agg(F.max_by("_before", F.when(F.col("_before").isNotNull(), some)).alias("_b"),
                                              F.min_by("_after", F.when(F.col("_after").isNotNull(), some)).alias("_a"))
    wp = Window.partitionBy(*group)
    ends = ends.select(*group, "_pid", F.last("_b", True).over(wp.orderBy("_pid").rowsBetween(*_PAST)).alias("_pb"),
                       F.last("_a", True).over(wp.orderBy(F.desc("_pid")).rowsBetween(*_TO_COME)).alias("_na"))
    w = Window.partitionBy(*group, "_pid")
    prev = F.last("_before", True).over(w.orderBy("_mono").rowsBetween(*_PAST))
    next_ = F.last("_after", True).over(w.orderBy(F.desc("_mono")).rowsBetween(*_TO_COME))
    return (tagged.join(ends, [*group, "_pid"])
            .withColumns({"prev": F.coalesce(prev, "_pb"), "next": F.coalesce(next_, "_na")})
            .drop("_mono", "_pid", "_before", "_after", "_pb", "_na"))


def _at(t: str = "starttime_us") -> Column:
    return F.struct(F.col("event_idx").alias("i"), F.col(t).alias("t"))


def _visit_at() -> Column:
    return F.struct(F.col("event_idx").alias("i"), F.col("hadm_id").alias("v"))


def _of(kind: str, value: Column) -> Column:
    return F.when(F.col("file_name") == kind, value)


def _block_carries(events: DataFrame) -> DataFrame:
    """(subject_id, block, dod, last_start, ...) for every block of the subjects with more than one: what the other blocks hold."""
    b = events.groupBy(*_KEY).agg(
        F.max("dod_us").alias("dod"), F.max_by("starttime_us", "event_idx").alias("end"), F.max("starttime_us").alias("latest"),
        F.min("starttime_us").alias("earliest"),
        F.min(_of("edstays", _at())).alias("ed"), F.min(_of("admissions", _at())).alias("adm"),
        F.max(_of("admissions", _visit_at())).alias("adm_last"), F.max(_of("discharge", _visit_at())).alias("dis_last"))
    s = Window.partitionBy("subject_id")
    ahead, behind = s.orderBy("block").rowsBetween(*_PAST), s.orderBy(F.desc("block")).rowsBetween(*_TO_COME)
    return (b.withColumns({
        "n_blocks": F.max("block").over(s) + 1, "x_dod": F.max("dod").over(s), "x_prev_start": F.lag("end").over(s.orderBy("block")),
        "x_latest": F.max("latest").over(ahead), "x_earliest": F.min("earliest").over(behind),
        "x_ed": F.last("ed", True).over(behind), "x_adm": F.last("adm", True).over(behind),
        "x_adm_asof": F.last("adm_last", True).over(ahead), "x_dis_asof": F.last("dis_last", True).over(ahead)})
        .where("n_blocks > 1").drop("dod", "end", "latest", "earliest", "ed", "adm", "adm_last", "dis_last", "n_blocks"))


def _visit_carries(big: DataFrame) -> DataFrame:
    """(subject_id, block, visits): what later blocks hold of a visit in this one, by visit; visits of one block are not listed."""
    v = big.where(F.col("hadm_id").isNotNull()).groupBy(*_KEY, "hadm_id").agg(
        F.min(_of("admissions", _at())).alias("adm"), F.min(_of("icustays", _at())).alias("icu"),
        F.max(F.when(F.col("starttime_us").isNotNull(), _at())).alias("timed"))
    w = Window.partitionBy("subject_id", "hadm_id")
    behind = w.orderBy(F.desc("block")).rowsBetween(*_TO_COME)
    v = v.select(*_KEY, "hadm_id", F.last("adm", True).over(behind).alias("adm"), F.last("icu", True).over(behind).alias("icu"),
                 F.max("timed").over(w).alias("timed"), F.count(F.lit(1)).over(w).alias("n")).where("n > 1")
    return v.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("hadm_id", F.struct("adm", "icu", "timed")))).alias("x_visits"))


def _far_bounds(big: DataFrame) -> DataFrame:
    """(subject_id, block, far): by event, the answers to the time bounds that lie in another block.

    ``big`` has the carried columns and ``t_back``. Data rows stand in the order of their visit and of
    their subject; a probe stands before the rows of its own time (back, until) or behind them (on)."""
    t_back, t, own, visit = F.col("t_back"), F.col("starttime_us"), F.lit("subject"), F.coalesce(F.concat(F.lit("visit "), F.col("hadm_id").cast("string")), F.lit("visit"))
    none = F.lit(None).cast("bigint")

    def row(scope, at, rank, back, on, asks):
        return F.struct(scope.alias("scope"), at.cast("bigint").alias("at"), F.lit(rank).alias("rank"), back.alias("back"), on.alias("on"), F.lit(asks).alias("asks"))

    timed = F.when(t.isNotNull(), _at())
    first = F.when(t_back.isNotNull() & (F.col("event_idx") >= 1), F.col("event_idx"))
    no_at = F.lit(None).cast("struct<i:bigint,t:bigint>")
    asked = [
        F.when(t_back.isNotNull(), row(visit, t_back, 1, first, timed, None)),
        F.when(t.isNotNull(), row(own, t, 1, none, timed, None)),
        F.when(t_back - (DAY_US - 1) <= F.col("x_latest"), row(visit, t_back - (DAY_US - 1), 0, none, no_at, "back")),
        F.when(t + (DAY_US - 1) >= F.col("x_earliest"), row(visit, t + (DAY_US - 1), 2, none, no_at, "on")),
        F.when((F.col("file_name") == "edstays") & (F.col("end_us") > F.col("x_earliest")), row(own, F.col("end_us"), 0, none, no_at, "until"))]
    rows = (big.select(*_KEY, "event_idx", F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("r"))
            .select(*_KEY, "event_idx", "r.*"))
    found = neighbours(rows, ["subject_id", "scope"], [F.col("at"), F.col("rank"), F.col("event_idx")], F.col("on"), F.col("back"))
    per_event = found.where(F.col("asks").isNotNull()).groupBy(*_KEY, "event_idx").agg(
        F.max(F.when(F.col("asks") == "back", F.struct("next"))).alias("back"), F.max(F.when(F.col("asks") == "on", F.struct("prev"))).alias("on"),
        F.max(F.when(F.col("asks") == "until", F.struct("prev"))).alias("until"))
    return per_event.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("event_idx", F.struct("back", "on", "until")))).alias("x_far"))


def _back_time(w_idx) -> Column:
    """C4: diagnoses take the start of the event before (of the block before, for a block's first), for looking back only."""
    before = F.coalesce(F.lag(F.struct(F.col("starttime_us").alias("t"))).over(w_idx), F.struct(F.col("x_prev_start").alias("t")))
    return F.when(F.col("file_name") == "diagnoses_icd", before["t"]).otherwise(F.col("starttime_us"))


def with_context(events: DataFrame, block_events: int = BLOCK_EVENTS) -> DataFrame:
    """C1-C8 for every event (subject_id, event_idx, file_name, hadm_id, starttime_us, end_us, dod_us, ...); written once.

    Adds t_back, t_fwd (C4), ctx_begin (C1), ctx_last and ctx_last_icu with their times (C2), the next event of
    a kind in the visit or at all with its time (C5), last_in_visit_us (C6), admissions_id (C7) and last_discharge_id (C8),
    and the subject's dod_us."""
    events = events.withColumn("block", F.floor(F.col("event_idx") / block_events))
    keep = [c for c in events.columns if c not in ("dod_us", "block")]
    w_idx = Window.partitionBy(*_KEY).orderBy("event_idx")
    if events.where(F.col("event_idx") >= block_events).isEmpty():  # a filter on the events' key: no subject has a second block
        whole = events.withColumns({c: F.lit(None).cast(t) for c, t in _CARRIED.items()})
    else:
        events = materialize(events)
        carried = materialize(_block_carries(events))
        big = events.join(carried, _KEY).withColumn("t_back", _back_time(w_idx))
        carried = carried.join(_visit_carries(big), _KEY, "left").join(_far_bounds(big), _KEY, "left")
        whole = events.join(materialize(carried.select(*_KEY, *_CARRIED)), _KEY, "left")

    idx, visit, kind = F.col("event_idx"), F.col("hadm_id"), F.col("file_name")
    # a task sorts its events five ways: adaptive execution must not put small partitions together here
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # windows of one order, whatever their frames, are one operator, and the operators stand in the order of their sorts
    asof, whole_block = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, Window.unboundedFollowing)
    st1 = whole.repartition(n, *_KEY).withColumns({
        "t_back": _back_time(w_idx), "t_fwd": F.col("starttime_us"),
        "dod_us": F.coalesce("x_dod", F.max("dod_us").over(w_idx.rowsBetween(*whole_block))),
        "_aa": F.coalesce(F.max(_of("admissions", _visit_at())).over(w_idx.rowsBetween(*asof)), "x_adm_asof"),
        "_da": F.coalesce(F.max(_of("discharge", _visit_at())).over(w_idx.rowsBetween(*asof)), "x_dis_asof")})
    tb, tf = F.col("t_back"), F.col("t_fwd")
    w_visit = Window.partitionBy(*_KEY, "hadm_id")
    w_later = Window.partitionBy(*_KEY).orderBy(idx.desc()).rowsBetween(*_TO_COME)
    w_visit_later = w_visit.orderBy(idx.desc())
    own, far = F.try_element_at("x_visits", visit), F.try_element_at("x_far", idx)
    later = st1.withColumns({
        "_en": F.coalesce(F.min(_of("edstays", _at("t_fwd"))).over(w_later), "x_ed"),
        "_an": F.coalesce(F.min(_of("admissions", _at("t_fwd"))).over(w_later), "x_adm")})
    in_visit = later.withColumns({
        "_ans": F.coalesce(F.min(_of("admissions", _at("t_fwd"))).over(w_visit_later.rowsBetween(*_TO_COME)), own["adm"]),
        "_ins": F.coalesce(F.min(_of("icustays", _at("t_fwd"))).over(w_visit_later.rowsBetween(*_TO_COME)), own["icu"]),
        "_lv": F.coalesce(own["timed"], F.max(F.when(tf.isNotNull(), _at("t_fwd"))).over(w_visit_later.rowsBetween(*whole_block)))})
    back = in_visit.withColumn("_cb", F.min(F.when(tb.isNotNull() & (idx >= 1), idx)).over(w_visit.orderBy("t_back").rangeBetween(-(DAY_US - 1), 0)))
    st2 = back.select(
        *keep, "block", "dod_us", "t_back", "t_fwd", far.alias("_far"), "x_earliest", "_ans", "_ins", "_en", "_an", "_lv", "_aa", "_da", "_cb",
        F.max(F.when(tf.isNotNull(), _at("t_fwd"))).over(w_visit.orderBy("t_fwd").rangeBetween(0, DAY_US - 1)).alias("_cf"))
    # a bound in another block is answered there, for the own block as well
    begin = F.when(F.col("_far.back").isNotNull(), F.col("_far.back.next")).otherwise(F.col("_cb"))
    last = F.when(F.col("_far.on").isNotNull(), F.col("_far.on.prev")).otherwise(F.col("_cf"))
    st3 = st2.withColumns({"_cb": begin, "_cf": last})
    same, fwd_ok = visit.isNotNull(), tf.isNotNull() & (F.col("_cf.i") > idx)
    icu_ok = fwd_ok & same
    differs = visit.isNull() | F.col("_da.v").isNull() | (F.col("_da.v") != visit)
    return materialize(st3.select(
        *keep, "dod_us", "t_back", "t_fwd", "block",
        F.when(F.col("_far.until").isNotNull(), F.struct(F.col("_far.until.prev.i").alias("i"))).alias("far_until"),
        F.when(tb.isNotNull() & (F.col("_cb") < idx), F.col("_cb")).alias("ctx_begin"),
        F.when(fwd_ok, F.col("_cf.i")).alias("ctx_last"), F.when(fwd_ok, F.col("_cf.t")).alias("ctx_last_us"),
        F.when(icu_ok, F.col("_cf.i")).alias("ctx_last_icu"), F.when(icu_ok, F.col("_cf.t")).alias("ctx_last_icu_us"),
        F.when(same, F.col("_ans.i")).alias("adm_next_same"), F.when(same, F.col("_ans.t")).alias("adm_next_same_us"),
        F.when(same, F.col("_ins.i")).alias("icu_next_same"), F.when(same, F.col("_ins.t")).alias("icu_next_same_us"),
        F.col("_en.i").alias("ed_next"), F.col("_en.t").alias("ed_next_us"), F.col("_an.i").alias("adm_next"), F.col("_an.t").alias("adm_next_us"),
        F.when(same & (F.col("_lv.i") > idx), F.col("_lv.t")).alias("last_in_visit_us"),
        F.when(F.col("_aa.v") == visit, F.col("_aa.i")).alias("admissions_id"),
        F.when(F.col("_da").isNotNull() & differs, F.col("_da.i")).alias("last_discharge_id")))


def context_until(prepared: DataFrame, probe_kind: str = "edstays", limit_col: str = "end_us", out: str = "ctx_until") -> DataFrame:
    """The stays among the rows of :func:`with_context`, each with the largest j > i (any visit) whose start is
    strictly before the stay's own end.

    Stays stand as probes at their end among their block's events, and the running last event is taken; an end
    beyond the block has been answered by :func:`with_context`."""
    probes = (prepared.where(F.col("file_name") == probe_kind)
              .withColumns({"_t": F.col(limit_col), "_rank": F.lit(0), "_i": F.lit(None).cast("bigint")}))
    timed = prepared.where(F.col("t_fwd").isNotNull()).select(
        *_KEY, F.col("t_fwd").alias("_t"), F.lit(1).alias("_rank"), F.col("event_idx").cast("bigint").alias("_i"))
    w = Window.partitionBy(*_KEY).orderBy(F.col("_t").asc_nulls_last(), "_rank", "_i").rowsBetween(Window.unboundedPreceding, 0)
    found = probes.unionByName(timed, allowMissingColumns=True).withColumn("_best", F.max("_i").over(w)).where(F.col("_rank") == 0)
    best = F.when(F.col("far_until").isNotNull(), F.col("far_until.i")).otherwise(F.col("_best"))
    return found.withColumn(out, F.when(F.col("_t").isNotNull() & (best > F.col("event_idx")), best)).drop("_t", "_rank", "_i", "_best")
