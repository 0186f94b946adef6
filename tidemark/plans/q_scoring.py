"""G family queries. Model outputs are derived from the given tables:

* ``conversations``: each assistant turn is an output; the user turn before it is the
  question; the gold answer is the question's first token; outputs with more than
  three lines end with 'The answer is <first token of the output>.'
* the task index: a 'repeat the previous target' baseline predicts every sample
  from the previous sample of the same subject and task.
* ``labels`` x ``documents``: score = n_chars, label = quality (AUROC).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scoring as fs
from tidemark.functions.text import extract_answer, has_answer, split_prediction, split_thinking
from tidemark.operators import scoring as so
from tidemark.plans import bindings as b
from tidemark.plans.oracle import cte, ctes
from tidemark.plans.registry import query
from tidemark.sources.tables import table
from tidemark.spec import task_frame

NL = "chr(10)"


def _tok_sql(x):
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def pairs(spark, sf):
    conv = table(spark, sf, "conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("qturn"), F.col("text").alias("q"))
    a = conv.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("a"))
    p = a.join(u, (a.conv_id == u.conv_id) & (u.qturn == a.turn - 1)).drop(u.conv_id).drop("qturn")
    gold = F.try_element_at(so.rouge_tokens("q"), F.lit(1))
    w = F.try_element_at(so.rouge_tokens("a"), F.lit(1))
    many = F.size(F.split("a", "\n")) > 3
    traj = F.when(many & w.isNotNull(), F.concat("a", F.lit(" The answer is "), w, F.lit("."))).otherwise(F.col("a"))
    think = F.when(F.size(F.split("a", "\n")) > 2,
                   F.concat(F.lit("<think>## Extraction "), F.col("q"), F.lit(" ## Reasoning ## Final Results</think>"),
                            F.col("a"))).otherwise(F.col("a"))
    return p.select("conv_id", "turn", "q", "a", F.coalesce(gold, F.lit("")).alias("gold"),
                    F.upper(F.substring(F.coalesce(gold, F.lit("")), 1, 1)).alias("answer_idx"),
                    traj.alias("trajectory"), think.alias("completion"))


cte("o_pairs", (), f"""
  SELECT a.conv_id, a.turn, u.text AS q, a.text AS a,
         coalesce({_tok_sql('u.text')}[1], '') AS gold,
         upper(substr(coalesce({_tok_sql('u.text')}[1], ''), 1, 1)) AS answer_idx,
         CASE WHEN len(string_split(a.text, {NL})) > 3 AND {_tok_sql('a.text')}[1] IS NOT NULL
              THEN a.text || ' The answer is ' || {_tok_sql('a.text')}[1] || '.' ELSE a.text END AS trajectory,
         CASE WHEN len(string_split(a.text, {NL})) > 2
              THEN '<think>## Extraction ' || u.text || ' ## Reasoning ## Final Results</think>' || a.text
              ELSE a.text END AS completion
  FROM conversations a JOIN conversations u
    ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
  WHERE a.role = 'assistant'""")

_EXTRACT_SQL = """CASE WHEN regexp_matches({t}, '[T|t]he answer is ')
      THEN trim(regexp_extract({t}, '(?s)^.*[T|t]he answer is (.*?)(\\.|$)', 1), ' ' || chr(10) || '*{{')
      ELSE right({t}, 100) END"""
_EXTRACT_END_SQL = """CASE WHEN regexp_matches({t}, '[T|t]he answer is ')
      THEN trim(regexp_extract({t}, '(?s)^.*[T|t]he answer is (.*)$', 1), ' ' || chr(10) || '*{{')
      ELSE right({t}, 100) END"""
KEYP = ["conv_id", "turn"]


def _prf_sql(lab, pred):
    inter = f"len(list_intersect(list_distinct({lab}), list_distinct({pred})))"
    p = f"(CASE WHEN len(list_distinct({pred})) > 0 THEN {inter} / len(list_distinct({pred})) ELSE 0.0 END)"
    r = f"(CASE WHEN len(list_distinct({lab})) > 0 THEN {inter} / len(list_distinct({lab})) ELSE 0.0 END)"
    f = f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
    return p, r, f


def _lower_list(x):
    return f"list_transform({x}, lambda s: lower(s))"


_P, _R, _F = _prf_sql(_tok_sql("q"), _tok_sql("a"))


@query("g_set_prf", ctes("o_pairs") + f"""
SELECT conv_id, turn, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F}, 6) AS f1 FROM o_pairs""")
def g_set_prf(spark, sf):
    p = pairs(spark, sf)
    s = fs.set_prf(so.rouge_tokens("q"), so.rouge_tokens("a"))
    return p.select(*KEYP, *[F.round(s[c], 6).alias(c) for c in ("precision", "recall", "f1")])


@query("g_prefix_acc", """
SELECT l.doc_id, CASE WHEN starts_with(CASE WHEN d.n_chars > 1000 THEN 'yes, long' ELSE 'no' END,
                                       CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END) THEN 1.0 ELSE 0.0 END::DOUBLE AS acc
FROM labels l JOIN documents d USING (doc_id)""")
def g_prefix_acc(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    label = F.when(F.col("quality") == 1, F.lit("yes")).otherwise(F.lit("no"))
    pred = F.when(F.col("n_chars") > 1000, F.lit("yes, long")).otherwise(F.lit("no"))
    return d.select("doc_id", fs.prefix_acc(label, pred).alias("acc"))


cte("o_rouge", ("o_pairs",), f"""
  SELECT conv_id, turn, n_ref, n_pred, coalesce(ov, 0) AS overlap FROM (
    SELECT conv_id, turn, len({_tok_sql('q')}) AS n_ref, len({_tok_sql('a')}) AS n_pred FROM o_pairs) s
  LEFT JOIN (
    SELECT conv_id, turn, sum(least(cr, cp)) AS ov FROM
      (SELECT conv_id, turn, tok, count(*) AS cr FROM (SELECT conv_id, turn, unnest({_tok_sql('q')}) AS tok FROM o_pairs)
       GROUP BY ALL) r
      JOIN (SELECT conv_id, turn, tok, count(*) AS cp FROM (SELECT conv_id, turn, unnest({_tok_sql('a')}) AS tok FROM o_pairs)
       GROUP BY ALL) p USING (conv_id, turn, tok)
    GROUP BY conv_id, turn) o USING (conv_id, turn)""")


@query("g_rouge1", ctes("o_rouge") + """
SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1
FROM (SELECT conv_id, turn, CASE WHEN n_pred > 0 THEN overlap / n_pred ELSE 0.0 END AS p,
             CASE WHEN n_ref > 0 THEN overlap / n_ref ELSE 0.0 END AS r FROM o_rouge)""")
def g_rouge1(spark, sf):
    r = so.rouge1(pairs(spark, sf), KEYP, "q", "a")
    return r.select(*KEYP, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("g_contains", """
SELECT doc_id, CASE WHEN contains(lower(text), lower(lang)) THEN 1.0 ELSE 0.0 END::DOUBLE AS acc FROM documents""")
def g_contains(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fs.contains_acc("lang", "text").alias("acc"))


# --- metric dispatch over the task index with a repeat-previous-target baseline ---


def _task_values_sql():
    from tidemark.spec import TASKS
    return ", ".join(f"('{t.task}', '{t.metric}')" for t in TASKS)


cte("o_scored_in", ("o_index",), f"""
  SELECT i.subject_id, i.event_idx, i.task, t.metric, i.target,
         replace(coalesce(lag(i.target) OVER (PARTITION BY i.subject_id, i.task ORDER BY i.event_idx), ''), '|', chr(10))
           AS prediction
  FROM o_index i JOIN (VALUES {_task_values_sql()}) t(task, metric) USING (task)""")

_SP = f"list_transform(string_split(prediction, {NL}), lambda x: trim(x))"
_LB = "string_split(target, '|')"
_SP2, _SR2, _SF2 = _prf_sql(_lower_list(_LB), _lower_list(_SP))
def _scored_sql(src, more=""):
    return f"""
  SELECT subject_id, event_idx, task{more}, metric, round({_SP2}, 6) AS precision, round({_SR2}, 6) AS recall,
         round({_SF2}, 6) AS f1, CAST(NULL AS DOUBLE) AS acc
  FROM {src} WHERE metric IN ('em', 'f1', 'recall', 'precision')
  UNION ALL
  SELECT subject_id, event_idx, task{more}, metric, NULL, NULL, NULL,
         CASE WHEN starts_with(prediction, target) THEN 1.0 ELSE 0.0 END
  FROM {src} WHERE metric IN ('acc', 'aucroc')
  UNION ALL
  SELECT subject_id, event_idx, task{more}, metric, round(p, 6), round(r, 6),
         round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6), NULL
  FROM (SELECT *, CASE WHEN n_pred > 0 THEN ov / n_pred ELSE 0.0 END AS p,
               CASE WHEN n_ref > 0 THEN ov / n_ref ELSE 0.0 END AS r
        FROM (SELECT s.*, len({_tok_sql('target')}) AS n_ref, len({_tok_sql('prediction')}) AS n_pred,
                     coalesce((SELECT sum(least(cr, cp)) FROM
                        (SELECT tok, count(*) AS cr FROM (SELECT unnest({_tok_sql('s.target')}) AS tok) GROUP BY tok) r
                        JOIN (SELECT tok, count(*) AS cp FROM (SELECT unnest({_tok_sql('s.prediction')}) AS tok) GROUP BY tok) q
                        USING (tok)), 0) AS ov
              FROM {src} s WHERE metric = 'rouge'))"""


cte("o_scored", ("o_scored_in",), _scored_sql("o_scored_in"))
cte("o_multi_in", ("o_scored_in",), """
  SELECT subject_id, event_idx, task, metric, target, o.out_idx,
         CASE o.out_idx WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS prediction
  FROM (SELECT *, replace(coalesce(lag(target, 1) OVER w, ''), '|', chr(10)) AS p1,
               replace(coalesce(lag(target, 2) OVER w, ''), '|', chr(10)) AS p2,
               replace(coalesce(lag(target, 3) OVER w, ''), '|', chr(10)) AS p3
        FROM (SELECT * EXCLUDE (prediction) FROM o_scored_in)
        WINDOW w AS (PARTITION BY subject_id, task ORDER BY event_idx)) s, (VALUES (1), (2), (3)) o(out_idx)""")

KEYI = ["subject_id", "event_idx", "task"]


def _scored_in(spark, sf, idx=None):
    idx = (idx if idx is not None else b.task_index(spark, sf)).join(F.broadcast(task_frame(spark).select("task", "metric")), "task")
    w = Window.partitionBy("subject_id", "task").orderBy("event_idx")
    return idx.select(*KEYI, "metric", F.col("target").alias("labels"),
                      F.array_join("target", "|").alias("label_text"),
                      F.coalesce(F.array_join(F.lag("target").over(w), "\n"), F.lit("")).alias("prediction"))


def _scored(spark, sf):
    s = so.score_by_metric(_scored_in(spark, sf), KEYI)
    return s.select(*KEYI, "metric", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "acc")])


@query("g_score_dispatch", ctes("o_scored") + "SELECT * FROM o_scored")
def g_score_dispatch(spark, sf):
    return _scored(spark, sf)


@query("g_split_pred", """
SELECT conv_id, turn, len(parts) AS n_parts, array_to_string(parts, '|') AS all_parts FROM (
  SELECT conv_id, turn, list_transform(CASE WHEN contains(text, '\\n') THEN string_split(text, '\\n')
                                             ELSE string_split(text, chr(10)) END, lambda x: trim(x)) AS parts
  FROM conversations WHERE role = 'assistant')""")
def g_split_pred(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    parts = split_prediction("text")
    return c.select("conv_id", "turn", F.size(parts).cast("bigint").alias("n_parts"), F.array_join(parts, "|").alias("all_parts"))


@query("g_score_multi", ctes("o_multi_in") + _scored_sql("o_multi_in", ", out_idx"))
def g_score_multi(spark, sf):
    s = _scored_in(spark, sf)
    w = Window.partitionBy("subject_id", "task").orderBy("event_idx")
    preds = F.array(*[F.coalesce(F.array_join(F.lag("labels", k).over(w), "\n"), F.lit("")) for k in (1, 2, 3)])
    m = so.score_multi(s.withColumn("preds", preds), KEYI, "labels", "preds")
    return m.select(*KEYI, "metric", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"), *(f"{c}_list" for c in so.SCORES)).select(
        *KEYI, (F.col("i") + 1).alias("out_idx"), "metric", *(F.round(F.get(f"{c}_list", F.col("i")), 6).alias(c) for c in so.SCORES))


_CP, _CR, _CF = _prf_sql("[lower(gold)]", f"list_transform(CASE WHEN contains(a, '\\n') THEN string_split(a, '\\n') ELSE string_split(a, {NL}) END, lambda x: lower(trim(x)))")


@query("g_cdm_diagnosis", ctes("o_pairs") + f"""
SELECT conv_id, turn, 'cdm_diagnosis' AS metric, round({_CP}, 6) AS precision, round({_CR}, 6) AS recall, round({_CF}, 6) AS f1,
       CASE WHEN contains(lower(a), lower(gold)) THEN 1.0 ELSE 0.0 END::DOUBLE AS acc FROM o_pairs""")
def g_cdm_diagnosis(spark, sf):
    p = pairs(spark, sf).withColumns({"metric": F.lit("cdm_diagnosis"), "labels": F.array("gold")})
    s = so.score_by_metric(p, KEYP, label_text="gold", prediction="a", category="gold")
    return s.select(*KEYP, "metric", *(F.round(c, 6).alias(c) for c in so.SCORES))


@query("g_extract_answer", ctes("o_pairs") + f"""
SELECT conv_id, turn, CASE WHEN regexp_matches(trajectory, '[T|t]he answer is ') THEN 1 ELSE 0 END AS has_answer,
       {_EXTRACT_SQL.format(t='trajectory')} AS prediction FROM o_pairs""")
def g_extract_answer(spark, sf):
    p = pairs(spark, sf)
    return p.select(*KEYP, has_answer("trajectory").cast("int").alias("has_answer"),
                    extract_answer("trajectory").alias("prediction"))


_CHOICE_SQL = f"""(contains(lower(pr), lower(gold)) OR contains(pr, answer_idx || '.')
                   OR (length(pr) = 1 AND pr = answer_idx))"""


@query("g_choice", ctes("o_pairs") + f"""
SELECT conv_id, turn, CASE WHEN {_CHOICE_SQL} THEN 1 ELSE 0 END AS correct
FROM (SELECT *, {_EXTRACT_SQL.format(t='trajectory')} AS pr FROM o_pairs)""")
def g_choice(spark, sf):
    p = pairs(spark, sf)
    return p.select(*KEYP, fs.choice_correct("trajectory", "gold", "answer_idx").cast("int").alias("correct"))


@query("g_entity", ctes("o_pairs") + f"""
SELECT conv_id, turn, CASE WHEN contains(lower({_EXTRACT_END_SQL.format(t='trajectory')}), lower(gold)) THEN 1 ELSE 0 END
       AS correct FROM o_pairs""")
def g_entity(spark, sf):
    p = pairs(spark, sf)
    return p.select(*KEYP, fs.entity_correct("trajectory", "gold").cast("int").alias("correct"))


cte("o_votes_in", ("o_pairs",), f"""
  SELECT conv_id, turn, pr AS answer, {_CHOICE_SQL} AS ok
  FROM (SELECT *, {_EXTRACT_SQL.format(t='trajectory')} AS pr FROM o_pairs)""")
cte("o_vote", ("o_votes_in",), """
  SELECT v.conv_id, v.answer AS vote_answer, CAST(v.ok AS DOUBLE) AS vote_acc, s.avg_acc, s.least_acc,
         s.positive, s.negative, s.n, s.c
  FROM (SELECT conv_id, answer, ok, row_number() OVER (PARTITION BY conv_id ORDER BY cnt DESC, first_turn) AS r
        FROM (SELECT conv_id, answer, count(*) AS cnt, min(turn) AS first_turn, max(CAST(ok AS INT)) AS ok
              FROM o_votes_in GROUP BY conv_id, answer)) v
  JOIN (SELECT conv_id, avg(CAST(ok AS DOUBLE)) AS avg_acc, max(CAST(ok AS DOUBLE)) AS least_acc,
               coalesce(string_agg(CAST(turn AS VARCHAR), '|' ORDER BY turn) FILTER (WHERE ok), '') AS positive,
               coalesce(string_agg(CAST(turn AS VARCHAR), '|' ORDER BY turn) FILTER (WHERE NOT ok), '') AS negative,
               count(*) AS n, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS c
        FROM o_votes_in GROUP BY conv_id) s USING (conv_id)
  WHERE v.r = 1""")


def _votes(spark, sf):
    p = pairs(spark, sf).select("conv_id", "turn", extract_answer("trajectory").alias("answer"),
                                fs.choice_correct("trajectory", "gold", "answer_idx").alias("ok"))
    return so.majority_vote(p, ["conv_id"], "turn", "answer", "ok")


@query("g_vote", ctes("o_vote") + "SELECT * FROM o_vote")
def g_vote(spark, sf):
    v = _votes(spark, sf)
    return v.select("conv_id", "vote_answer", "vote_acc", "avg_acc", "least_acc",
                    F.array_join(F.transform("positive", lambda x: x.cast("string")), "|").alias("positive"),
                    F.array_join(F.transform("negative", lambda x: x.cast("string")), "|").alias("negative"),
                    "n", F.col("c").cast("bigint").alias("c"))


@query("g_pass_at_k", ctes("o_vote") + """
SELECT conv_id, k, round(CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0
                              ELSE 1.0 - (SELECT product(1.0 - k / i) FROM range(n - c + 1, n + 1) r(i)) END, 6)
       AS pass_at_k
FROM o_vote, range(1, n + 1) kk(k)""")
def g_pass_at_k(spark, sf):
    v = _votes(spark, sf)
    return so.pass_at_k(v, ["conv_id"]).select("conv_id", "k", F.round("pass_at_k", 6).alias("pass_at_k"))


_DATASET_SQL = """CASE lang WHEN 'en' THEN 'medqa_5op_' || source WHEN 'fr' THEN 'medsins'
                  WHEN 'de' THEN 'open_mcqa_' || source ELSE source END"""


@query("g_dispatch_dataset", f"""
SELECT doc_id, dataset, CASE
  WHEN dataset IN ('medqa', 'medmcqa', 'mmlu', 'pubmedqa', 'bioasq', 'medqa_5op', 'mmlu_medcare') THEN 'single_choice'
  WHEN dataset IN ('medsins', 'medqa_open') THEN 'entity_match'
  WHEN dataset IN ('medical_o1', 'open_mcqa') THEN 'verifier'
  WHEN contains(dataset, 'medqa') OR contains(dataset, 'medmcqa') OR contains(dataset, 'mmlu')
       OR contains(dataset, 'pubmedqa') OR contains(dataset, 'bioasq') THEN 'single_choice'
  WHEN contains(dataset, 'medqa_5op') OR contains(dataset, 'mmlu_medcare') THEN 'single_choice'
  WHEN contains(dataset, 'medsins') OR contains(dataset, 'medqa_open') THEN 'entity_match'
  WHEN contains(dataset, 'medical_o1') OR contains(dataset, 'open_mcqa') THEN 'verifier'
  ELSE 'single_choice' END AS score_func
FROM (SELECT doc_id, {_DATASET_SQL} AS dataset FROM documents)""")
def g_dispatch_dataset(spark, sf):
    d = table(spark, sf, "documents")
    lang = F.col("lang")
    ds = (F.when(lang == "en", F.concat(F.lit("medqa_5op_"), F.col("source"))).when(lang == "fr", F.lit("medsins"))
          .when(lang == "de", F.concat(F.lit("open_mcqa_"), F.col("source"))).otherwise(F.col("source")))
    return d.select("doc_id", ds.alias("dataset")).withColumn("score_func", so.score_func_for("dataset"))


@query("g_split_think", ctes("o_pairs") + """
SELECT conv_id, turn,
       CASE WHEN n_close = 1 THEN split_part(completion, '</think>', 1) || '</think>' END AS reasoning,
       CASE WHEN n_close = 1 THEN trim(split_part(completion, '</think>', 2), ' ' || chr(9) || chr(10) || chr(13))
            ELSE completion END AS answer
FROM (SELECT *, (length(completion) - length(replace(completion, '</think>', ''))) // 8 AS n_close FROM o_pairs)""")
def g_split_think(spark, sf):
    p = pairs(spark, sf)
    s = split_thinking("completion")
    return p.select(*KEYP, s["reasoning"].alias("reasoning"), s["answer"].alias("answer"))


_LAB_SQL = f"list_sort(list_distinct({_tok_sql('q')}))"

#: An answer longer than its question closes by restating it, so that some answers hold their labels and others don't.
_RECAP_SQL = "CASE WHEN length(a) > length(q) THEN a || ' Final Results ' || lower(q) ELSE a END"


@query("g_reason_filter", ctes("o_pairs") + f"""
SELECT conv_id, count(*) AS n_kept, CAST(sum(length(a)) AS BIGINT) AS kept_chars FROM (
  SELECT conv_id, a, labs,
         len(list_filter(labs, lambda l: contains(string_split(a, 'Final Results')[-1], l))) / len(labs) AS ratio
  FROM (SELECT conv_id, {_RECAP_SQL} AS a, {_LAB_SQL} AS labs FROM o_pairs) WHERE len(labs) > 0)
WHERE ratio >= 0.7 AND NOT contains(lower(a), 'ground truth')
  AND NOT contains(a, 'Extraction and Analysis') AND NOT contains(a, 'Reasoning and Summary')
GROUP BY conv_id""")
def g_reason_filter(spark, sf):
    recap = F.when(F.length("a") > F.length("q"), F.concat("a", F.lit(" Final Results "), F.lower("q"))).otherwise(F.col("a"))
    p = pairs(spark, sf).where(F.size(so.rouge_tokens("q")) > 0).withColumn("a", recap)
    rows = p.select("conv_id", "turn", F.array_sort(F.array_distinct(so.rouge_tokens("q"))).alias("labels"),
                    F.array("a").alias("reasonings"), F.lit("conv").alias("task"), "a")
    kept = so.reasoning_filter(rows)
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_kept"), F.sum(F.length("a")).cast("bigint").alias("kept_chars"))


#: Every answer closes with the first tokens of its question, none to all of them by its length.
_PART_SQL = f"a || ' Final Results ' || array_to_string(list_slice({_tok_sql('q')}, 1, len({_tok_sql('q')}) * (length(a) % 11) // 10), ' ')"


@query("g_reason_filter_partial", ctes("o_pairs") + f"""
SELECT conv_id, turn, ratio >= 0.7 AND NOT contains(lower(a), 'ground truth')
  AND NOT contains(a, 'Extraction and Analysis') AND NOT contains(a, 'Reasoning and Summary') AS kept FROM (
  SELECT conv_id, turn, a, len(list_filter(labs, lambda l: contains(string_split(a, 'Final Results')[-1], l))) / len(labs) AS ratio
  FROM (SELECT conv_id, turn, {_PART_SQL} AS a, {_LAB_SQL} AS labs FROM o_pairs) WHERE len(labs) > 0)""")
def g_reason_filter_partial(spark, sf):
    tok = so.rouge_tokens("q")
    part = F.slice(tok, F.lit(1), F.floor(F.size(tok) * (F.length("a") % 11) / 10).cast("int"))
    rows = pairs(spark, sf).where(F.size(tok) > 0).select(
        "conv_id", "turn", F.array_sort(F.array_distinct(tok)).alias("labels"), F.lit("conv").alias("task"),
        F.array(F.concat("a", F.lit(" Final Results "), F.array_join(part, " "))).alias("reasonings"))
    kept = so.reasoning_filter(rows).select("conv_id", "turn", F.lit(True).alias("kept"))
    return rows.select("conv_id", "turn").join(kept, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("kept", F.lit(False)).alias("kept"))


_NB = "list_filter(list_transform(string_split({x}, chr(10)), lambda s: trim(s)), lambda s: s <> '')"
_TAIL = "split_part(completion, '</think>', -1)"
_RV_P, _RV_R, _RV_F = _prf_sql(_lower_list(_NB.format(x='a')), _lower_list(_NB.format(x=_TAIL)))


@query("g_reward_verify", ctes("o_pairs") + f"""
SELECT conv_id, turn, round(CASE WHEN NOT contains(completion, '</think>') THEN 0.0 ELSE {_RV_F} END, 6) AS reward
FROM o_pairs""")
def g_reward_verify(spark, sf):
    from tidemark.functions.text import nonblank_lines
    p = pairs(spark, sf)
    labels = nonblank_lines("a")
    return p.select(*KEYP, F.round(fs.reward_verify("completion", labels, F.lit("em")), 6).alias("reward"))


@query("g_reward_format", ctes("o_pairs") + f"""
SELECT conv_id, turn, CASE WHEN contains(completion, '</think>') AND contains(completion, '<think>')
   AND contains(r, '## Extraction') AND contains(r, '## Reasoning') AND contains(r, '## Final Results')
   AND len(list_distinct(lines)) = len(lines) THEN 1 ELSE -1 END AS fmt
FROM (SELECT *, left(completion, greatest(0, length(completion) - length({_TAIL}) - 8)) AS r,
             {_NB.format(x=_TAIL)} AS lines FROM o_pairs)""")
def g_reward_format(spark, sf):
    p = pairs(spark, sf)
    return p.select(*KEYP, fs.reward_format("completion").alias("fmt"))


# The probability of yes that a model would store beside each output: the share of a context of 20 events.
@query("g_leaderboard", ctes("o_scored", "o_index") + """
, p AS (SELECT i.task, i.target = 'yes' AS yes, least((context_end - context_begin) / 20.0, 1.0) AS prob
        FROM o_index i WHERE i.task IN (SELECT task FROM o_scored WHERE metric = 'aucroc')),
g AS (SELECT task, prob, count(*) FILTER (yes) AS pos, count(*) FILTER (NOT yes) AS neg FROM p GROUP BY ALL),
u AS (SELECT a.task, sum(a.pos * b.neg * CASE WHEN b.prob < a.prob THEN 1.0 WHEN b.prob = a.prob THEN 0.5 ELSE 0 END) AS u
      FROM g a JOIN g b USING (task) GROUP BY a.task),
r AS (SELECT task, sum(pos) AS pos, sum(neg) AS neg FROM g GROUP BY task)
SELECT s.task, s.metric, CASE WHEN s.metric <> 'aucroc' THEN round(avg(coalesce(s.f1, s.acc)), 6)
                    ELSE round(CASE WHEN any_value(r.pos) > 0 AND any_value(r.neg) > 0
                                    THEN any_value(u.u) / (any_value(r.pos) * any_value(r.neg)) END, 6) END AS score, count(*) AS n
FROM o_scored s LEFT JOIN u USING (task) LEFT JOIN r USING (task) GROUP BY s.task, s.metric""")
def g_leaderboard(spark, sf):
    idx = b.task_index(spark, sf)
    s = so.score_by_metric(_scored_in(spark, sf, idx), KEYI).withColumn("score", F.round(F.coalesce("f1", "acc"), 6))
    prob = F.least((F.col("context_end") - F.col("context_begin")) / 20.0, F.lit(1.0))
    told = idx.select(*KEYI, prob.alias("probability"), (F.element_at("target", 1) == "yes").cast("int").alias("label"))
    board = so.leaderboard(s.join(told, KEYI))
    return board.select("task", "metric", F.round("score", 6).alias("score"), "n")


@query("g_auroc", """
SELECT lang, count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg,
       round((SELECT CASE WHEN count(*) > 0 THEN
                       (count(*) FILTER (WHERE p.n_chars > q.n_chars) + 0.5 * count(*) FILTER (WHERE p.n_chars = q.n_chars))
                       / count(*) END
              FROM (SELECT * FROM labels JOIN documents USING (doc_id)) p
              JOIN (SELECT * FROM labels JOIN documents USING (doc_id)) q ON p.lang = q.lang
              WHERE p.lang = g.lang AND p.quality = 1 AND q.quality = 0), 6) AS auroc
FROM (SELECT * FROM labels JOIN documents USING (doc_id)) g GROUP BY lang""")
def g_auroc(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    a = so.auroc(d, ["lang"], "n_chars", "quality")
    return a.select("lang", "n_pos", "n_neg", F.round("auroc", 6).alias("auroc"))
