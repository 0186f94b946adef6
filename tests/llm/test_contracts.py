"""The registered queries over whole small tables against the brute-force versions."""

import hashlib
import os
import re
import sys
import html
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from tidemark.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(table, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def docs():
    return rows("documents", "doc_id, text")


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_op1(spark):
    same(Q.op1_url_filters(spark, SF).collect(), [(p, *brute.url(u, Q.URL_RULES)) for p, u in rows("pages", "page_id, url")])


def test_op2(spark):
    def article(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())
    got = Q.op2_html_extraction(spark, SF).collect()
    same([(r.page_id, r.url, r.text, r.n_chars) for r in got],
         [(p, u, article(h), len(article(h))) for p, u, h in rows("pages", "page_id, url, html")])


def test_op3(spark, docs):
    got = Q.op3_quality_rules(spark, SF).collect()
    same([tuple(r)[:7] for r in got], [(d, *brute.quality_counts(t)) for d, t in docs])


def test_op4(spark):
    got = Q.op4_chat_formatting(spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.n_copies) for r in got} == brute.maximal(rows("conversations", "conv_id, turn, role, text"))


def test_op5(spark, docs):
    same(Q.op5_line_dedup(spark, SF).collect(), brute.line_dedup(docs))


def test_op6(spark):
    same(Q.op6_warc(spark, SF).collect(), brute.warc(rows("pages", "page_id, html")))


def test_op7(spark, docs):
    same(Q.op7_benchmark_decontamination(spark, SF).collect(), brute.contamination(docs, rows("benchmark", "item_id, text")))


def test_op8(spark, docs):
    fps = [(d, brute.fingerprint(t)) for d, t in docs]
    comp = brute.components(fps)
    same(Q.op8_simhash_near_dedup(spark, SF).collect(), [(d, "%016x" % f, comp[d, f]) for d, f in fps])


def test_op9_held_out(spark):
    """Accuracy on labelled documents that the fit has not seen."""
    from pyspark.sql import functions as F
    from tidemark.llm.quality_classifier import classify
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    unseen = {r.doc_id: r for r in labels.where("doc_id % 4 = 0").collect()}
    got = {r.doc_id: r for r in classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("doc_id % 4 <> 0")).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = [(got[d].quality >= 0.5) == (r.quality == 1) for d, r in unseen.items()]
    assert sum(right) / len(right) > 0.9
    clean = [got[d].kept for d, r in unseen.items() if r.quality == 1 and r.toxic == 0]
    assert sum(clean) / len(clean) > 0.95


def test_op10(spark, docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(Q.tokenizer_path())
    want = []
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    got = Q.op10_best_fit_packing(spark, SF).collect()
    same([tuple(r)[:5] for r in got], want)
    used = {r.sequence_id for r in got}
    assert len(used) <= 1.02 * -(-sum(w[3] for w in want) // 2048) + 1


def test_op11(spark, docs):
    import base64
    import public_tokenizers
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(Q.tokenizer_path("byte_bpe_50k.tiktoken"), "rb"))}
    want = [(d, brute.byte_pair_ids(t, ranks, public_tokenizers.PATTERN), t or "") for d, t in docs]
    same(Q.op11_byte_bpe(spark, SF).collect(), [(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                                 hashlib.sha256(t.encode()).hexdigest()) for d, ids, t in want])


def test_op12(spark, docs):
    got = Q.op12_periodic_runs(spark, SF).collect()
    same(got, [brute.run_row(d, brute.made_runs(d, t)) for d, t in docs])
    assert sum(r.n_runs > 0 for r in got) >= len(docs) // 20


def test_op13(spark):
    want = brute.hard_negatives(rows("embeddings", "vec_id, embedding, label"))
    same(Q.op13_hard_negatives(spark, SF).collect(), want)
    assert len(want) > 100


def test_pipeline(spark, docs):
    """run() against the stages done by hand on the brute-force versions."""
    kept = {r.doc_id for r in Q.op3_quality_rules(spark, SF).collect() if r.kept}
    stage = [(d, t) for d, t in docs if d in kept]
    holders = {}
    for d, t in stage:
        for x in (t or "").split("\n"):
            holders.setdefault(x.strip(brute.SPACE).translate(brute.LOWER), set()).add(d)
    stage = [(d, "\n".join(x for x in (t or "").split("\n") for k in [x.strip(brute.SPACE).translate(brute.LOWER)]
                           if not (len(k) >= 40 and len(holders[k]) >= 5 and d != max(holders[k])))) for d, t in stage]
    fps = [(d, brute.fingerprint(t)) for d, t in stage]
    comp = brute.components(fps)
    stay = {d for d, f in fps if comp[d, f] == d}
    stage = [(d, t) for d, t in stage if d in stay]
    judged = brute.contamination(stage, rows("benchmark", "item_id, text"))
    clean = {w[0] for w in judged if not w[5]}
    got = Q.pipeline(spark, SF).collect()
    assert {r.doc_id for r in got} == clean
    assert len(clean) < len(docs)
