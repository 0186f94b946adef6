"""F family queries: concepts are the list-valued decision targets of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import concepts as cc
from tidemark.operators import graph as gr
from tidemark.operators import matching as mt
from tidemark.plans import bindings as b
from tidemark.plans.oracle import cte, ctes
from tidemark.plans.q_render import INSTR_SQL, contexts, instructions, keyed
from tidemark.plans.registry import query
from tidemark.session import materialize
from tidemark.sources.tables import table
from tidemark.spec import TASKS, task_frame

LIST_TASKS = ("admissions", "labevents", "diagnoses_icd")
SAMPLE_TASKS = LIST_TASKS + ("next_event",)
LT_SQL = ", ".join(f"'{t}'" for t in LIST_TASKS)
ST_SQL = ", ".join(f"'{t}'" for t in SAMPLE_TASKS)
MIN_SUPPORT, THRESHOLD, TOPK = 5, 5.0, 20


def parts(spark, sf, pl=None):
    """(samples, targets_long, history, concept table) with the history materialized."""
    pl = pl or b.pipeline(spark, sf, keep_targets=True)
    targets, idx = pl.targets, pl.index
    samples = idx.where(F.col("task").isin(*SAMPLE_TASKS))
    concepts = cc.event_concepts(targets, LIST_TASKS)
    history = materialize(cc.history_concepts(samples, concepts))
    tlong = cc.target_concepts(samples, LIST_TASKS)
    return samples, tlong, history, concepts


def lifts(spark, sf, pl=None):
    samples, tlong, history, _ = parts(spark, sf, pl)
    n_c, n_task = cc.concept_num(samples, tlong, history)
    n_c = materialize(n_c)
    lf = materialize(cc.lift(cc.coexist(tlong, cc.supported(history, n_c, MIN_SUPPORT)), n_c, n_task, MIN_SUPPORT))
    return samples, tlong, history, lf


def related(spark, sf):
    samples, tlong, history, lf = lifts(spark, sf)
    return materialize(cc.related_concepts(tlong, history, lf, THRESHOLD, TOPK))


cte("o_concepts", ("o_targets",), f"""
  SELECT DISTINCT subject_id, event_idx AS h_idx, unnest(string_split(target, '|')) AS concept
  FROM o_targets WHERE task IN ({LT_SQL})""")
cte("o_fsamples", ("o_index",), f"SELECT * FROM o_index WHERE task IN ({ST_SQL})")
cte("o_hist", ("o_fsamples", "o_concepts"), """
  SELECT DISTINCT s.subject_id, s.event_idx, s.task, c.concept
  FROM o_fsamples s JOIN o_concepts c ON c.subject_id = s.subject_id
   AND ((c.h_idx >= s.context_begin AND c.h_idx < s.context_end)
        OR c.h_idx = s.last_discharge_id OR c.h_idx = s.admissions_id)""")
cte("o_tlong", ("o_fsamples",), f"""
  SELECT DISTINCT subject_id, event_idx, task, unnest(string_split(target, '|')) AS concept
  FROM o_fsamples WHERE task IN ({LT_SQL})""")
cte("o_cnum", ("o_tlong", "o_hist"), """
  SELECT task, concept, count(*) AS n FROM (SELECT * FROM o_tlong UNION SELECT * FROM o_hist) GROUP BY task, concept""")
cte("o_ntask", ("o_fsamples",), "SELECT task, count(*) AS n_samples FROM o_fsamples GROUP BY task")
cte("o_coexist", ("o_tlong", "o_hist"), """
  SELECT t.task, t.concept AS target_concept, h.concept AS history_concept, count(*) AS n_pair
  FROM o_tlong t JOIN o_hist h USING (subject_id, event_idx, task) GROUP BY ALL""")
cte("o_lift", ("o_coexist", "o_cnum", "o_ntask"), f"""
  SELECT p.task, p.target_concept, p.history_concept, p.n_pair, h.n AS n_h, t.n AS n_t, k.n_samples,
         p.n_pair * k.n_samples / (h.n * t.n) AS lift
  FROM o_coexist p JOIN o_cnum h ON h.task = p.task AND h.concept = p.history_concept AND h.n >= {MIN_SUPPORT}
  JOIN o_cnum t ON t.task = p.task AND t.concept = p.target_concept JOIN o_ntask k ON k.task = p.task""")
cte("o_related", ("o_tlong", "o_hist", "o_lift"), f"""
  SELECT * FROM (
    SELECT t.subject_id, t.event_idx, t.task, t.concept AS target_concept, h.concept AS history_concept, l.lift,
           row_number() OVER (PARTITION BY t.subject_id, t.event_idx, t.task, t.concept
                              ORDER BY l.lift DESC, h.concept) AS rank
    FROM o_tlong t JOIN o_hist h USING (subject_id, event_idx, task)
    JOIN o_lift l ON l.task = t.task AND l.target_concept = t.concept AND l.history_concept = h.concept
    WHERE t.concept <> h.concept AND l.lift > {THRESHOLD})
  WHERE rank <= {TOPK}""")


@query("f_event_concepts", ctes("o_concepts") + "SELECT subject_id, h_idx AS event_idx, concept FROM o_concepts")
def f_event_concepts(spark, sf):
    targets = b.pipeline(spark, sf).targets
    return cc.event_concepts(targets, LIST_TASKS).select("subject_id", F.col("h_idx").alias("event_idx"), "concept")


@query("f_history", ctes("o_hist") + "SELECT * FROM o_hist")
def f_history(spark, sf):
    return parts(spark, sf)[2]


@query("f_concept_num", ctes("o_cnum", "o_ntask") + "SELECT c.*, k.n_samples FROM o_cnum c JOIN o_ntask k USING (task)")
def f_concept_num(spark, sf):
    samples, tlong, history, _ = parts(spark, sf)
    n_c, n_task = cc.concept_num(samples, tlong, history)
    return n_c.join(n_task, "task")


@query("f_coexist", ctes("o_coexist") + "SELECT * FROM o_coexist")
def f_coexist(spark, sf):
    _, tlong, history, _ = parts(spark, sf)
    return cc.coexist(tlong, history)


@query("f_lift", ctes("o_lift") + """
SELECT task, target_concept, history_concept, n_pair, n_h, n_t, n_samples, round(lift, 9) AS lift FROM o_lift""")
def f_lift(spark, sf):
    lf = lifts(spark, sf)[3]
    return lf.select("task", "target_concept", "history_concept", "n_pair", "n_h", "n_t", "n_samples",
                     F.round("lift", 9).alias("lift"))


@query("f_topk_pairs", ctes("o_related") + """
SELECT subject_id, event_idx, task, target_concept, history_concept, round(lift, 9) AS lift, rank FROM o_related""")
def f_topk_pairs(spark, sf):
    r = related(spark, sf)
    return r.select(*cc.SAMPLE, "target_concept", "history_concept", F.round("lift", 9).alias("lift"),
                    F.col("rank").cast("bigint").alias("rank"))


# Dictionary: word bigrams and trigrams of the benchmark passages, plus their words of
# 10+ letters (benchmark passages are quoted inside some documents), and the accented and other
# non-ASCII words of the documents with the word that follows them.
def _words_sql(text):
    return rf"list_filter(string_split(regexp_replace(lower({text}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


_BW = _words_sql("text")
_FOREIGN_SQL = r"regexp_matches(w[s + 1], '[^\x00-\x7F]')"
TERMS_SQL = f"""
  SELECT DISTINCT term FROM (
    SELECT array_to_string(w[s + 1 : s + n], ' ') AS term
    FROM (SELECT {_BW} AS w FROM benchmark), (VALUES (2), (3)) nn(n),
         LATERAL (SELECT unnest(range(0, greatest(len(w) - n + 1, 0))) AS s)
    UNION ALL
    SELECT t FROM (SELECT unnest({_BW}) AS t FROM benchmark) WHERE length(t) >= 10
    UNION ALL
    SELECT array_to_string(w[s + 1 : s + n], ' ')
    FROM (SELECT {_BW} AS w FROM documents), (VALUES (1), (2)) nn(n),
         LATERAL (SELECT unnest(range(0, greatest(len(w) - n + 1, 0))) AS s)
    WHERE {_FOREIGN_SQL})"""


def _grams(words, sizes, keep=None):
    """The runs of ``sizes`` words, of those that start with a word that ``keep`` accepts; all from one scan."""
    def runs(i, word):
        return F.array(*(F.when(i + n <= F.size("w"), word if n == 1 else F.array_join(F.slice("w", i + 1, n), " ")) for n in sizes))
    starts = F.transform("w", lambda word, i: runs(i, word) if keep is None else F.when(keep(word), runs(i, word)))
    found = F.filter(starts, lambda r: r.isNotNull())
    return words.select(F.explode(F.flatten(found)).alias("term")).where(F.col("term").isNotNull())


def _terms(spark, sf):
    def words(name):
        return table(spark, sf, name).select(F.filter(F.split(mt.words_text(F.col("text")), " "), lambda x: x != "").alias("w"))
    bench = words("benchmark")
    long_words = bench.select(F.explode("w").alias("term")).where(F.length("term") >= 10)
    foreign = _grams(words("documents"), (1, 2), lambda w: w.rlike(r"[^\x00-\x7F]"))
    return _grams(bench, (2, 3)).unionByName(long_words).unionByName(foreign).distinct()


cte("o_terms", (), TERMS_SQL)
cte("o_words", (), f"SELECT doc_id, {_BW} AS w FROM documents")
cte("o_hits", ("o_words", "o_terms"), """
  SELECT g.doc_id, g.start, g.n, g.term FROM (
    SELECT doc_id, n, s.start, array_to_string(w[s.start + 1 : s.start + n], ' ') AS term
    FROM o_words, (VALUES (1), (2), (3)) nn(n), LATERAL (SELECT unnest(range(0, greatest(len(w) - n + 1, 0))) AS start) s
  ) g JOIN o_terms d USING (term)""")


@query("f_text_concepts", ctes("o_hits") + """
SELECT doc_id, term, count(*) AS n_hits FROM o_hits a
WHERE NOT EXISTS (SELECT 1 FROM o_hits b WHERE b.doc_id = a.doc_id AND b.n > a.n AND b.start <= a.start
                  AND a.start + a.n <= b.start + b.n)
GROUP BY doc_id, term""")
def f_text_concepts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mt.text_concepts(docs, "doc_id", "text", _terms(spark, sf))


EDGES_SQL = """
  SELECT p_name AS a, lower(p_type) AS b FROM part UNION SELECT p_name, p_brand FROM part
  UNION SELECT 'condition ' || p_name, p_name FROM part UNION SELECT 'disorder ' || lower(p_type), lower(p_type) FROM part"""


def _edges(spark, sf):
    p = table(spark, sf, "part")
    return (p.select(F.col("p_name").alias("a"), F.lower("p_type").alias("b"))
            .unionByName(p.select(F.col("p_name").alias("a"), F.col("p_brand").alias("b")))
            .unionByName(p.select(F.concat(F.lit("condition "), F.col("p_name")).alias("a"), F.col("p_name").alias("b")))
            .unionByName(p.select(F.concat(F.lit("disorder "), F.lower("p_type")).alias("a"), F.lower("p_type").alias("b")))
            .distinct())


cte("o_edges", (), f"""
  SELECT a AS u, b AS v FROM ({EDGES_SQL}) WHERE a <> b UNION SELECT b, a FROM ({EDGES_SQL}) WHERE a <> b""")
cte("o_reach", ("o_related", "o_edges"), """
  SELECT src AS dst, node, min(hops) AS hops FROM (
    WITH RECURSIVE bfs(src, node, hops) USING KEY (src, node) AS (
      SELECT DISTINCT history_concept, history_concept, 0 FROM o_related
      UNION
      SELECT DISTINCT bfs.src, e.v, bfs.hops + 1 FROM bfs JOIN o_edges e ON e.u = bfs.node
      WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs seen WHERE seen.src = bfs.src AND seen.node = e.v))
    SELECT * FROM bfs) GROUP BY ALL""")
# from src always to the smallest neighbour that is nearer to dst
cte("o_paths", ("o_reach",), """
  SELECT p.src, p.dst, w.hops, w.path FROM (SELECT DISTINCT target_concept AS src, history_concept AS dst FROM o_related) p
  LEFT JOIN (
    WITH RECURSIVE walk(src, dst, node, path, hops, togo) AS (
      SELECT q.src, q.dst, q.src, [q.src], r.hops, r.hops
      FROM (SELECT DISTINCT target_concept AS src, history_concept AS dst FROM o_related) q JOIN o_reach r ON r.dst = q.dst AND r.node = q.src
      UNION ALL
      SELECT w.src, w.dst, n.v, list_append(w.path, n.v), w.hops, w.togo - 1
      FROM walk w JOIN (SELECT r.dst, e.u, r.hops, min(e.v) AS v FROM o_edges e JOIN o_reach r ON r.node = e.v GROUP BY r.dst, e.u, r.hops) n
        ON n.dst = w.dst AND n.u = w.node AND n.hops = w.togo - 1)
    SELECT * FROM walk WHERE togo = 0) w ON w.src = p.src AND w.dst = p.dst""")


def _paths(spark, sf, rel=None):
    rel = rel if rel is not None else related(spark, sf)
    pairs = rel.select(F.col("target_concept").alias("src"), F.col("history_concept").alias("dst")).distinct()
    return gr.shortest_paths(pairs, _edges(spark, sf))


@query("f_paths", ctes("o_paths") + "SELECT src, dst, hops, array_to_string(path, ' > ') AS path FROM o_paths")
def f_paths(spark, sf):
    return _paths(spark, sf).select("src", "dst", "hops", F.array_join("path", " > ").alias("path"))


cte("o_kept_paths", ("o_paths",), """
  SELECT DISTINCT r.subject_id, r.event_idx, r.task, p.src, p.dst, p.hops, p.path
  FROM o_related r JOIN o_paths p ON p.hops IS NOT NULL
   AND ((p.src = r.target_concept AND p.dst = r.history_concept) OR (p.dst = r.target_concept AND p.src = r.history_concept))""")


@query("f_filter_paths", ctes("o_kept_paths") + """
SELECT subject_id, event_idx, task, src, dst, hops, array_to_string(path, ' > ') AS path FROM o_kept_paths""")
def f_filter_paths(spark, sf):
    rel = related(spark, sf)
    p = _paths(spark, sf, rel).where(F.col("path").isNotNull())
    return cc.filter_paths(p, rel).select(*cc.SAMPLE, "src", "dst", "hops", F.array_join("path", " > ").alias("path"))


_DECISION_SQL = ", ".join(f"'{t.task}'" for t in TASKS if t.task_type == "decision_making")


@query("f_evidence", ctes("o_kept_paths") + f"""
SELECT i.subject_id, i.event_idx, i.task,
       '{{"related":[' || r.related || '],"paths":[' || k.paths || ']}}' AS evidence
FROM (SELECT subject_id, event_idx, task FROM o_index WHERE task IN ({_DECISION_SQL})) i
LEFT JOIN (SELECT subject_id, event_idx, task, string_agg('{{"target":' || to_json(target_concept) || ',"history":' || to_json(history_concept)
             || ',"lift_micro":' || CAST(floor(lift * 1000000) AS BIGINT) || '}}', ',' ORDER BY target_concept, rank) AS related
           FROM o_related GROUP BY ALL) r USING (subject_id, event_idx, task)
LEFT JOIN (SELECT subject_id, event_idx, task, string_agg(CAST(to_json(path) AS VARCHAR), ',' ORDER BY path) AS paths
           FROM (SELECT DISTINCT subject_id, event_idx, task, path FROM o_kept_paths) GROUP BY ALL) k USING (subject_id, event_idx, task)""")
def f_evidence(spark, sf):
    pl = b.pipeline(spark, sf, keep_targets=True)
    _, tlong, history, lf = lifts(spark, sf, pl)
    rel = materialize(cc.related_concepts(tlong, history, lf, THRESHOLD, TOPK))
    asked = pl.index.join(F.broadcast(task_frame(spark).where(F.col("task_type") == "decision_making").select("task")), "task", "left_semi")
    found = cc.sample_evidence(asked, rel, _paths(spark, sf, rel))
    e = F.col("evidence")
    # the lift as a whole number: the two engines print floating-point numbers differently
    record = F.struct(F.transform(e["related"], lambda r: F.struct(r["target"].alias("target"), r["history"].alias("history"),
                                                                  F.floor(r["lift"] * 1000000).alias("lift_micro"))).alias("related"), e["paths"].alias("paths"))
    return found.select(*cc.SAMPLE, F.when(e.isNotNull(), F.to_json(record)).alias("evidence"))


def _graphs(rel):
    """The related findings of a sample as text."""
    return rel.groupBy(*cc.SAMPLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "target_concept", "rank", F.concat("target_concept", F.lit(" -> "), "history_concept").alias("l")))),
        lambda x: x["l"]), "\n").alias("graph"))


def _request_sql(kind):
    from tidemark.operators.render import REQUEST_TEMPLATES
    text = "'" + REQUEST_TEMPLATES[kind].replace("\n", "' || chr(10) || '") + "'"
    for slot, value in (("context", "c.input"), ("graph", "g.graph"), ("answer", "replace(c.target, '|', chr(10))"), ("instruction", "i.instruction")):
        text = text.replace("{" + slot + "}", f"' || {value} || '")
    return text


def _requests(samples, graph):
    """Each sample's request by each template; NULL where a template needs a graph and there is none."""
    from tidemark.operators.render import REQUEST_TEMPLATES, reasoning_request
    requests = []
    for kind in REQUEST_TEMPLATES:
        p = reasoning_request(F.col("input"), F.col("instruction"), F.array_join("target", "\n"), F.col("graph"), kind)
        requests.append(F.struct(F.lit(kind).alias("kind"), F.md5(p).alias("prompt_md5"), F.length(p).cast("bigint").alias("prompt_len")))
    return samples.join(graph, cc.SAMPLE, "left").select(*cc.SAMPLE, F.explode(F.array(*requests)).alias("r")).select(*cc.SAMPLE, "r.*")


@query("e_reason_prompt", ctes("o_related", "o_ctx") + f"""
SELECT subject_id, event_idx, task, kind, md5(prompt) AS prompt_md5, length(prompt) AS prompt_len FROM (
  SELECT c.subject_id, c.event_idx, c.task, k.kind,
         CASE k.kind WHEN 'graph' THEN {_request_sql("graph")} WHEN 'nograph' THEN {_request_sql("nograph")} ELSE {_request_sql("free")} END AS prompt
  FROM o_ctx c JOIN {INSTR_SQL.replace(" ins(", " i(")} ON i.task = c.task
  CROSS JOIN (VALUES ('graph'), ('nograph'), ('free')) k(kind)
  LEFT JOIN (SELECT subject_id, event_idx, task, string_agg(target_concept || ' -> ' || history_concept, chr(10) ORDER BY target_concept, rank) AS graph
             FROM o_related GROUP BY ALL) g ON g.subject_id = c.subject_id AND g.event_idx = c.event_idx AND g.task = c.task
  WHERE c.task IN ({LT_SQL})) WHERE kind <> 'graph' OR prompt IS NOT NULL""")
def e_reason_prompt(spark, sf):
    pl = b.pipeline(spark, sf, keep_targets=True)
    _, ctx = contexts(spark, sf, pl, carry=("target",), tasks=LIST_TASKS)
    _, tl_, hist, lf = lifts(spark, sf, pl)
    graph = _graphs(cc.related_concepts(tl_, hist, lf, THRESHOLD, TOPK))
    return _requests(ctx.join(F.broadcast(instructions(spark)), "task"), graph).where((F.col("kind") != "graph") | F.col("prompt_md5").isNotNull())


@query("e_reason_request", ctes("o_related", "o_ctx") + f"""
SELECT subject_id, event_idx, task, kind, md5(prompt) AS prompt_md5, length(prompt) AS prompt_len FROM (
  SELECT c.subject_id, c.event_idx, c.task, k.kind,
         CASE k.kind WHEN 'graph' THEN {_request_sql("graph")} WHEN 'nograph' THEN {_request_sql("nograph")} ELSE {_request_sql("free")} END AS prompt
  FROM o_ctx c JOIN {INSTR_SQL.replace(" ins(", " i(")} ON i.task = c.task
  CROSS JOIN (VALUES ('graph'), ('nograph'), ('free')) k(kind)
  LEFT JOIN (SELECT subject_id, event_idx, task, string_agg(target_concept || ' -> ' || history_concept, chr(10) ORDER BY target_concept, rank) AS graph
             FROM o_related GROUP BY ALL) g ON g.subject_id = c.subject_id AND g.event_idx = c.event_idx AND g.task = c.task
  WHERE c.target <> '') WHERE prompt IS NOT NULL""")
def e_reason_request(spark, sf):
    pl = b.pipeline(spark, sf, keep_targets=True)
    _, ctx = contexts(spark, sf, pl, carry=("target",))
    _, tl_, hist, lf = lifts(spark, sf, pl)
    graph = _graphs(cc.related_concepts(tl_, hist, lf, THRESHOLD, TOPK))
    s = keyed(ctx).where(F.size("target") > 0).join(F.broadcast(instructions(spark)), "task")
    return _requests(s, graph).where(F.col("prompt_md5").isNotNull())
