"""D family queries on the bound task index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.keys import uniform_sql
from tidemark.operators import sampling as sm
from tidemark.operators.labels import CONFIGURED_KINDS
from tidemark.operators.similar import nearest_items
from tidemark.plans import bindings as b
from tidemark.plans.oracle import cte, ctes
from tidemark.plans.registry import query
from tidemark.sources.tables import table
from tidemark.spec import TASKS, WEIGHTED_TASKS, task_frame

SEED = 42
KEY = sm.SAMPLE_KEY
KEY_SQL = "CAST(subject_id AS VARCHAR) || ':' || CAST(event_idx AS VARCHAR) || ':' || task"
RISK = tuple(t.task for t in TASKS if t.task_type == "risk_prediction")
RISK_SQL = ", ".join(f"'{t}'" for t in RISK)
WEIGHTED_SQL = ", ".join(f"'{t}'" for t in WEIGHTED_TASKS)

# Sampling configuration of the bound run (task -> quota; -1 = all). Configuration, not data.
CONFIG = {"admissions": 300, "labevents": 1000, "diagnoses_icd": 100, "discharge": 50, "next_event": 2000}
CONFIG.update({t: -1 for t in RISK})
CONFIG.update({"ED_Hospitalization": 200, "LengthOfStay_3day": 300, "ICU_Mortality_1day": 500})
CONFIG_SQL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in CONFIG.items()) + ") cfg(task, quota)"


def _config(spark):
    return spark.createDataFrame(list(CONFIG.items()), "task string, quota bigint")


def _index(spark, sf):
    return b.task_index(spark, sf)


def _all_tasks(spark, sf):
    return b.record_index(spark, sf)


def _flat(df, cols=None):
    cols = cols or ["subject_id", "event_idx", "task"]
    out = df.select(*cols, F.array_join("target", "|").alias("target")) if "target" in df.columns else df.select(*cols)
    return out


def _quota(spark, idx):
    counts = idx.groupBy("task").agg(F.count(F.lit(1)).alias("n_available"))
    return sm.resolve_quota(counts, _config(spark))


cte("o_freq", ("o_index",), """
  SELECT task, v AS target_value, count(*) AS n
  FROM (SELECT task, unnest(string_split(target, '|')) AS v FROM o_index) GROUP BY task, v""")
cte("o_freq_rec", ("o_index_rec",), """
  SELECT task, v AS target_value, count(*) AS n
  FROM (SELECT task, unnest(string_split(target, '|')) AS v FROM o_index_rec) GROUP BY task, v""")
cte("o_weighted", ("o_freq",), """
  SELECT i.*, w.target_weight FROM o_index i JOIN (
    SELECT subject_id, event_idx, task, 1.0 / avg(f.n) AS target_weight
    FROM (SELECT subject_id, event_idx, task, unnest(string_split(target, '|')) AS target_value FROM o_index) x
    JOIN o_freq f USING (task, target_value) GROUP BY subject_id, event_idx, task) w
  USING (subject_id, event_idx, task)""")
cte("o_quota", ("o_index",), f"""
  SELECT task, n_available, CAST(quota AS BIGINT) AS quota,
         CAST(CASE WHEN quota > 0 AND quota < n_available THEN quota END AS BIGINT) AS n_take
  FROM (SELECT task, count(*) AS n_available FROM o_index GROUP BY task) c JOIN {CONFIG_SQL} USING (task)""")


@query("d_target_freq", ctes("o_freq_rec") + "SELECT * FROM o_freq_rec")
def d_target_freq(spark, sf):
    return sm.target_freq(_all_tasks(spark, sf))


@query("d_target_weight", ctes("o_weighted") +
       "SELECT subject_id, event_idx, task, round(target_weight, 9) AS target_weight FROM o_weighted")
def d_target_weight(spark, sf):
    return sm.target_weight(_index(spark, sf)).select(*KEY, F.round("target_weight", 9).alias("target_weight"))


_SPLIT_SQL = "(SELECT c_custkey AS subject_id FROM customer WHERE c_mktsegment = 'BUILDING')"


def _split_subjects(spark, sf):
    return (table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
            .select(F.col("c_custkey").alias("subject_id")))


@query("d_semi_subject", ctes("o_index_rec") + f"""
SELECT subject_id, event_idx, task, target FROM o_index_rec WHERE subject_id IN {_SPLIT_SQL}""")
def d_semi_subject(spark, sf):
    return _flat(sm.subject_split(_all_tasks(spark, sf), _split_subjects(spark, sf)))


@query("d_ctx_len", ctes("o_index_rec") + """
SELECT subject_id, event_idx, task, target FROM o_index_rec
WHERE context_end - context_begin > 2 AND context_end - context_begin < 5""")
def d_ctx_len(spark, sf):
    return _flat(sm.context_length_filter(_all_tasks(spark, sf), 2, 5))


@query("d_admit_cover", ctes("o_index_rec") + """
SELECT subject_id, event_idx, task, target FROM o_index_rec
WHERE task NOT IN ('procedures_icd', 'procedures_ccs', 'diagnoses_icd', 'diagnoses_ccs')
   OR admissions_id IS NULL OR admissions_id > context_begin""")
def d_admit_cover(spark, sf):
    return _flat(sm.admission_cover_filter(_all_tasks(spark, sf)))


@query("d_anti_known", ctes("o_index") + f"""
SELECT subject_id, event_idx, task, target FROM o_index i
WHERE NOT EXISTS (SELECT 1 FROM o_index k WHERE k.subject_id IN {_SPLIT_SQL}
                  AND k.task = i.task AND k.subject_id = i.subject_id AND k.context_end = i.context_end)""")
def d_anti_known(spark, sf):
    idx = _index(spark, sf)
    known = sm.project_index(sm.subject_split(idx, _split_subjects(spark, sf)))
    return _flat(sm.exclude_known(idx, known))


@query("d_semi_label", ctes("o_index") + f"""
SELECT subject_id, event_idx, task, target FROM o_index i
WHERE subject_id NOT IN {_SPLIT_SQL}
  AND (EXISTS (SELECT 1 FROM o_index r WHERE r.subject_id IN {_SPLIT_SQL} AND r.task = i.task AND r.target = i.target)
       OR NOT EXISTS (SELECT 1 FROM o_index r WHERE r.subject_id IN {_SPLIT_SQL} AND r.task = i.task))""")
def d_semi_label(spark, sf):
    idx = _index(spark, sf)
    subj = _split_subjects(spark, sf)
    ref = sm.subject_split(idx, subj)
    rest = idx.join(subj, "subject_id", "left_anti")
    return _flat(sm.in_label_filter(rest, ref))


@query("d_label_len", ctes("o_index") + """
SELECT subject_id, event_idx, task, target FROM o_index
WHERE task NOT IN ('labevents', 'diagnoses_icd') OR len(string_split(target, '|')) < 2""")
def d_label_len(spark, sf):
    return _flat(sm.label_len_filter(_index(spark, sf), ("labevents", "diagnoses_icd"), 2))


@query("d_quota", ctes("o_quota") + "SELECT * FROM o_quota")
def d_quota(spark, sf):
    return _quota(spark, _index(spark, sf)).select("task", "n_available", "quota", "n_take")


@query("d_sample_uniform", ctes("o_quota") + f"""
SELECT subject_id, event_idx, task, target FROM (
  SELECT i.*, q.n_take, row_number() OVER (PARTITION BY task ORDER BY {uniform_sql(SEED, KEY_SQL)},
                                           subject_id, event_idx, task) AS rn
  FROM o_index i JOIN o_quota q USING (task)
  WHERE task NOT IN ({RISK_SQL}) AND task NOT IN ({WEIGHTED_SQL}))
WHERE n_take IS NULL OR rn <= n_take""")
def d_sample_uniform(spark, sf):
    idx = _index(spark, sf)
    q = _quota(spark, idx)
    part = idx.where(~F.col("task").isin(*RISK, *WEIGHTED_TASKS))
    return _flat(sm.sample_uniform(part, q, SEED))


@query("d_sample_weighted", ctes("o_weighted", "o_quota") + f"""
SELECT subject_id, event_idx, task, target FROM (
  SELECT i.*, q.n_take, row_number() OVER (PARTITION BY task ORDER BY
           -ln({uniform_sql(SEED, KEY_SQL)}) / target_weight, subject_id, event_idx, task) AS rn
  FROM o_weighted i JOIN o_quota q USING (task)
  WHERE task IN ({RISK_SQL}) OR task IN ({WEIGHTED_SQL}))
WHERE n_take IS NULL OR rn <= n_take""")
def d_sample_weighted(spark, sf):
    idx = _index(spark, sf)
    q = _quota(spark, idx)
    part = sm.target_weight(idx).where(F.col("task").isin(*RISK, *WEIGHTED_TASKS))
    return _flat(sm.sample_weighted(part, q, SEED))


@query("d_sample_balanced", ctes("o_quota") + f"""
SELECT subject_id, event_idx, task, target FROM (
  SELECT i.*, floor(q.n_take / k.k) AS per,
         row_number() OVER (PARTITION BY task, target ORDER BY {uniform_sql(SEED, KEY_SQL)},
                            subject_id, event_idx, task) AS rn
  FROM o_index i JOIN o_quota q USING (task)
  JOIN (SELECT task, count(DISTINCT target) AS k FROM o_index GROUP BY task) k USING (task)
  WHERE task IN ({RISK_SQL}))
WHERE per IS NULL OR rn <= per""")
def d_sample_balanced(spark, sf):
    idx = _index(spark, sf)
    q = _quota(spark, idx)
    return _flat(sm.sample_balanced(idx.where(F.col("task").isin(*RISK)), q, SEED))


@query("d_index_project", ctes("o_index_rec") + """
SELECT subject_id, hadm_id, task, event, context_begin AS period_begin, context_end AS period_end,
       admissions_id, last_discharge_id, target FROM o_index_rec""")
def d_index_project(spark, sf):
    idx = _all_tasks(spark, sf)
    dec = idx.where(~F.col("task").isin(*RISK))
    risk = idx.where(F.col("task").isin(*RISK))
    return sm.project_index(dec, risk).withColumn("target", F.array_join("target", "|"))


@query("d_task_report", ctes("o_index_rec") + """
SELECT coalesce(task, 'TOTAL') AS task, count(*) AS n_samples FROM o_index_rec GROUP BY ROLLUP (task)""")
def d_task_report(spark, sf):
    return sm.task_report(_all_tasks(spark, sf))


@query("d_shuffle_mix", ctes("o_index") + f"""
SELECT source, subject_id, event_idx, task,
       round({uniform_sql(SEED, "source || ':' || " + KEY_SQL)}, 9) AS mix_key
FROM (SELECT *, CASE WHEN task IN ({RISK_SQL}) THEN 'b' ELSE 'a' END AS source FROM o_index)""")
def d_shuffle_mix(spark, sf):
    idx = _index(spark, sf).select(*KEY)
    a = idx.join(task_frame(spark).where(F.col("task_type") == "decision_making").select("task"), "task", "left_semi")
    bb = idx.join(task_frame(spark).where(F.col("task_type") == "risk_prediction").select("task"), "task", "left_semi")
    return sm.shuffle_mix(a, bb, SEED, KEY).select("source", *KEY, F.round("mix_key", 9).alias("mix_key"))


@query("d_curriculum_mix", ctes("o_index") + f"""
SELECT source, subject_id, event_idx, task, round(t, 9) AS t FROM (
  SELECT *, CASE WHEN source = 'b' THEN theta + (1 - theta) * sqrt(u)
                 WHEN u * (theta + (1 - theta) / 2) < theta THEN u * (theta + (1 - theta) / 2)
                 ELSE 1 - (1 - theta) * sqrt(greatest(0, 1 - 2 * (u * (theta + (1 - theta) / 2) - theta) / (1 - theta)))
            END AS t
  FROM (SELECT *, {uniform_sql(SEED, "source || ':' || " + KEY_SQL)} AS u,
               greatest(0.0, 1.0 - 2.0 * (count(*) FILTER (WHERE source = 'b') OVER ())
                                    / (count(*) FILTER (WHERE source = 'a') OVER ())) AS theta
        FROM (SELECT *, CASE WHEN task IN ('discharge', 'diagnoses_icd') THEN 'b' ELSE 'a' END AS source FROM o_index)))""")
def d_curriculum_mix(spark, sf):
    idx = _index(spark, sf).select(*KEY)
    late = F.col("task").isin("discharge", "diagnoses_icd")
    a, bb = idx.where(~late), idx.where(late)
    return sm.curriculum_mix(a, bb, SEED, KEY).select("source", *KEY, F.round("t", 9).alias("t"))


@query("d_keep_multiple", ctes("o_index") + f"""
SELECT subject_id, event_idx, task FROM (
  SELECT *, row_number() OVER (ORDER BY {uniform_sql(SEED, KEY_SQL)}, subject_id, event_idx, task) AS rn,
         count(*) OVER () AS n FROM o_index)
WHERE rn <= n - n % 64""")
def d_keep_multiple(spark, sf):
    return sm.keep_multiple(_index(spark, sf).select(*KEY), SEED, KEY)


@query("d_split_filter", ctes("o_index") + f"""
SELECT subject_id, event_idx, task FROM (
  SELECT *, CASE WHEN subject_id IN {_SPLIT_SQL} THEN 'val' WHEN event = 'labevents' THEN NULL ELSE 'train' END AS split
  FROM o_index) WHERE coalesce(split, 'train') = 'train'""")
def d_split_filter(spark, sf):
    idx = _index(spark, sf)
    subj = _split_subjects(spark, sf).withColumn("_val", F.lit(True))
    d = idx.join(subj, "subject_id", "left").withColumn(
        "split", F.when(F.col("_val"), F.lit("val")).when(F.col("event") == "labevents", F.lit(None))
        .otherwise(F.lit("train")))
    return sm.split_filter(d).select(*KEY)


@query("d_random_split", ctes("o_index") + f"""
SELECT subject_id, event_idx, task, CASE WHEN {uniform_sql(SEED, KEY_SQL)} < 0.001 THEN 'test' ELSE 'train' END AS split
FROM o_index""")
def d_random_split(spark, sf):
    return sm.random_split(_index(spark, sf), SEED, KEY).select(*KEY, "split")


# Known items of the tasks (their rows of the similar-item tables): lab items and diagnosis titles, with and
# without a brand, and the admission types; an item's vector is the embedding of its part.
N_SIMILAR, MAX_CANDIDATES = 20, 100
_ADMISSION_TYPES = ("EMERGENCY", "URGENT", "ELECTIVE")
cte("o_known", (), """
  SELECT task, item, min(p) AS p FROM (
    SELECT 'labevents' AS task, p_name AS item, p_partkey AS p FROM part
    UNION ALL SELECT 'labevents', p_name || ' ' || p_brand, p_partkey FROM part
    UNION ALL SELECT 'diagnoses_icd', 'condition ' || p_name, p_partkey FROM part
    UNION ALL SELECT 'diagnoses_icd', 'condition ' || p_name || ' ' || p_brand, p_partkey FROM part
    UNION ALL SELECT 'diagnoses_icd', 'disorder ' || lower(p_type), p_partkey FROM part) GROUP BY task, item""")
cte("o_vec", ("o_known",), """
  SELECT task, item, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM o_known JOIN embeddings ON vec_id = p % (SELECT count(*) FROM embeddings)""")
cte("o_labels", ("o_index",), f"""
  SELECT subject_id, event_idx, task, unnest(string_split(target, '|')) AS item FROM o_index WHERE task IN ('labevents', 'diagnoses_icd')""")
cte("o_similar", ("o_vec", "o_labels"), f"""
  SELECT task, item, neighbour FROM (
    SELECT a.task, a.item, b.item AS neighbour, row_number() OVER (PARTITION BY a.task, a.item ORDER BY
             list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), b.item) AS r
    FROM (SELECT * FROM o_vec SEMI JOIN o_labels USING (task, item)) a JOIN o_vec b ON a.task = b.task AND a.item <> b.item)
  WHERE r <= {N_SIMILAR}""")
cte("o_pool", ("o_labels", "o_similar"), f"""
  SELECT subject_id, event_idx, task, neighbour AS c FROM (
    SELECT l.*, neighbour, row_number() OVER (PARTITION BY subject_id, event_idx, task ORDER BY
             {uniform_sql(SEED, KEY_SQL + " || ':' || item || ':' || neighbour")}, item, neighbour) AS r
    FROM o_labels l JOIN o_similar USING (task, item)) WHERE r <= {MAX_CANDIDATES}
  UNION ALL SELECT * FROM o_labels""")


@query("d_candidates", ctes("o_pool") + f"""
SELECT i.subject_id, i.event_idx, i.task,
       CASE WHEN i.task IN ({RISK_SQL}) THEN 'no|yes' WHEN i.task = 'next_event' THEN '{"|".join(sorted(CONFIGURED_KINDS))}'
            WHEN i.task = 'admissions' THEN '{"|".join(sorted(_ADMISSION_TYPES))}' ELSE p.cands END AS candidates
FROM o_index i LEFT JOIN (SELECT subject_id, event_idx, task, string_agg(DISTINCT c, '|' ORDER BY c) AS cands FROM o_pool GROUP BY ALL) p
  USING (subject_id, event_idx, task)""")
def d_candidates(spark, sf):
    idx = _index(spark, sf).join(F.broadcast(task_frame(spark).select("task", "task_type")), "task")
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    branded = F.concat_ws(" ", "p_name", "p_brand")
    rows = [("labevents", F.col("p_name")), ("labevents", branded), ("diagnoses_icd", F.concat(F.lit("condition "), "p_name")),
            ("diagnoses_icd", F.concat(F.lit("condition "), branded)), ("diagnoses_icd", F.concat(F.lit("disorder "), F.lower("p_type")))]
    known = p.select(F.explode(F.array(*(F.struct(F.lit(t).alias("task"), i.alias("item"), F.col("p_partkey").alias("p")) for t, i in rows))).alias("k"))
    known = known.groupBy("k.task", "k.item").agg(F.min("k.p").alias("p"))
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    vectors = known.withColumn("vec_id", F.col("p") % F.lit(emb.count())).join(emb, "vec_id").select("task", "item", "vector")
    labels = idx.where(F.col("task").isin("labevents", "diagnoses_icd")).select("task", F.explode("target").alias("item"))
    similar = nearest_items(vectors, labels, N_SIMILAR).select("task", "item", "neighbour")
    types = spark.createDataFrame([("admissions", a) for a in _ADMISSION_TYPES], "task string, item string")
    vocab = known.select("task", "item").unionByName(types)
    c = sm.make_candidates(idx, vocab, similar, SEED, MAX_CANDIDATES, event_kinds=CONFIGURED_KINDS)
    return c.select(*KEY, F.array_join("candidates", "|").alias("candidates"))
