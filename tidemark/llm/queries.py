"""Registered queries of the llm operators, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (byte_bpe, chat_format, decontaminate, hard_negatives, html_extract, line_dedup, packing, periodic_runs, quality_classifier,
                          quality_rules, simhash, url_filter, warc)
from tidemark.sources.tables import table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return (url_filter.judge_urls(pages, url_filter.rules_frame(spark, URL_RULES))
            .select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), *(f"c.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                         "base_failed", "kept")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = decontaminate.n_hit()
    return found.select("doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    decoded = byte_bpe.decode(encoded.drop("text"), ranks, pattern)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.detect(periodic_runs.with_made_runs(docs))
    top = periodic_runs.longest(F.col("runs"))
    rows = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (found.select("doc.doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), rows.alias("rows"), "collapsed")
            .select("doc_id", "n_runs", "top.start", "top.length", "top.period",
                    F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
                    F.sha2("rows", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_url_filters, op2_html_extraction, op3_quality_rules, op4_chat_formatting, op5_line_dedup, op6_warc,
    op7_benchmark_decontamination, op8_simhash_near_dedup, op9_quality_classifier, op10_best_fit_packing, op11_byte_bpe, op12_periodic_runs,
    op13_hard_negatives, pipeline)}

_SPACE = r"[\x20\x09-\x0D]"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op1_url_filters": f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_LOWER}), '') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT p.*, r_host || r_path AS rule, r_verdict FROM parts p LEFT JOIN rules
         ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fits
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1""",
    "op3_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, k, count(*) OVER (PARTITION BY r, w[k:k + 7]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS k FROM t)),
rep AS (SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest(range(k, k + 8)) AS spot FROM win WHERE n > 1) GROUP BY r),
c AS (SELECT r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             len(ls) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words FROM t LEFT JOIN rep USING (r)),
slack(measure, slack, two_sided) AS (VALUES {", ".join(f"('{m}', {s}, {m in quality_rules.TWO_SIDED})" for m, s in quality_rules.MEASURES.items())}),
m AS (SELECT r, lang, source, 'symbols' AS measure, n_symbols * 1000 // greatest(n_words, 1) AS v FROM c
      UNION ALL SELECT r, lang, source, 'dup_lines', n_dup_lines * 1000 // greatest(n_lines, 1) FROM c
      UNION ALL SELECT r, lang, source, 'word_length', word_chars * 1000 // greatest(n_words, 1) FROM c
      UNION ALL SELECT r, lang, source, 'repeats', n_repeat_words * 1000 // greatest(n_words, 1) FROM c),
b AS (SELECT *, v - v % CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT) AS bucket FROM m),
g AS (SELECT grouping(lang, source) AS level, lang, source, measure, count(*) AS n,
             quantile_disc(bucket, 0.25) AS q25, quantile_disc(bucket, 0.5) AS q50, quantile_disc(bucket, 0.75) AS q75
      FROM b GROUP BY GROUPING SETS ((lang, source, measure), (lang, measure), (measure))),
e AS (SELECT g.*, q50 + greatest(slack, (q75 - q50) * 6) AS high,
             CASE WHEN two_sided THEN q50 - greatest(slack, (q50 - q25) * 6) ELSE -1 END AS low FROM g JOIN slack USING (measure)),
f AS (SELECT o.lang, o.source, o.measure, o.n >= 50 AND o.q75 <= CASE WHEN l.n >= 50 THEN l.high ELSE a.high END AS own,
             o.low AS o_low, o.high AS o_high, CASE WHEN l.n >= 50 THEN l.low ELSE a.low END AS w_low,
             CASE WHEN l.n >= 50 THEN l.high ELSE a.high END AS w_high
      FROM (SELECT * FROM e WHERE level = 0) o
      JOIN (SELECT * FROM e WHERE level = 1) l ON l.measure = o.measure AND l.lang IS NOT DISTINCT FROM o.lang
      JOIN (SELECT * FROM e WHERE level = 3) a ON a.measure = o.measure),
odd AS (SELECT DISTINCT r FROM m JOIN f ON f.measure = m.measure AND f.lang IS NOT DISTINCT FROM m.lang
        AND f.source IS NOT DISTINCT FROM m.source
        WHERE v > CASE WHEN own THEN o_high ELSE w_high END OR v < CASE WHEN own THEN o_low ELSE w_low END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND r NOT IN (SELECT r FROM odd) AS kept FROM c""",
    "op4_chat_formatting": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
             string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
                        ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS chat FROM t GROUP BY conv_id),
inner_ AS (SELECT DISTINCT turns[1:k] AS prefix FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)),
whole AS (SELECT min(conv_id) AS conv_id, len(turns) AS n_turns, count(*) AS n_copies, any_value(chat) AS chat, turns FROM c GROUP BY turns)
SELECT conv_id, n_turns, n_copies, chat FROM whole WHERE NOT EXISTS (SELECT 1 FROM inner_ WHERE prefix = turns)""",
    "op5_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), {_LOWER}) AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, s.last IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
         (CAST('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS INTEGER), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (html)""",
    "op7_benchmark_decontamination": rf"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_ALNUM}') AS w FROM benchmark),
n AS (SELECT item, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item, m, w[k:k + m - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM n)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_ALNUM}') AS w FROM documents),
dw AS (SELECT doc_id, m, k, w[k:k + m - 1] AS win FROM (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d JOIN (SELECT DISTINCT m FROM p) ON len(w) >= m)),
h AS (SELECT doc_id, k, dw.m, item FROM dw JOIN p ON dw.win = p.win AND dw.m = p.m),
x AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS spot FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN x USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 3""",
}
