"""The word trie against plain search: longest match, Unicode words, long terms, blocks of the dictionary."""

import random
import re
from collections import Counter

import pytest

from tidemark.operators import matching


def brute(rows, terms):
    def words(t):
        return re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    known = {tuple(words(t)) for t in terms} - {()}
    out = Counter()
    for key, text in rows:
        w = words(text)
        spans = [(i, i + len(t), t) for t in known for i in range(len(w) - len(t) + 1) if tuple(w[i:i + len(t)]) == t]
        for i, j, t in spans:
            if not any(a <= i and j <= b and b - a > j - i for a, b, _ in spans):
                out[key, " ".join(t)] += 1
    return dict(out)


def rows_and_terms(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "é", "Ärzte", "naïve", "日本", "x1", "O'Neil"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))) for _ in range(60)]
    texts += [None, "", "...", "a-b,c  A_B", "É É", "a " * 5000, "z " * 3000]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, "a b c"), (3, "a b c")]
    terms = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 6))) for _ in range(40)] + ["", None, "A B", "a b", "a, b", "É", "z " * 2000]
    return rows, terms


@pytest.mark.parametrize("seed,block_bytes", [(1, 1 << 20), (2, 200), (3, 40)])
def test_trie(spark, seed, block_bytes):
    rows, terms = rows_and_terms(seed)
    docs = spark.createDataFrame(rows, "id long, body string").repartition(3)
    dictionary = spark.createDataFrame([(t,) for t in terms], "term string")
    got = matching.text_concepts(docs, "id", "body", dictionary, block_bytes=block_bytes).collect()
    assert {(r.id, r.term): r.n_hits for r in got} == brute(rows, terms)
    assert len(got) == len({(r.id, r.term) for r in got})


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b")], "id long, body string")
    none = spark.createDataFrame([], "term string")
    assert matching.text_concepts(docs, "id", "body", none).count() == 0
    assert matching.text_concepts(docs.limit(0), "id", "body", spark.createDataFrame([("a",)], "term string")).count() == 0


def test_texts_are_read_once(spark):
    """A dictionary of many times ``block_bytes`` costs one pass over the texts, with the same matches."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300))), (2, "w1 w2 w9 w9 w9")], "id long, body string")
    dictionary = spark.createDataFrame([(f"w{i}",) for i in range(300)] + [("w1 w2",), ("w9 w9",)], "term string")
    found = matching.text_concepts(docs, "id", "body", dictionary, block_bytes=500)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r.id, r.term): r.n_hits for r in found.collect()}
    assert got == {(1, f"w{i}"): 1 for i in range(300) if i not in (1, 2)} | {(1, "w1 w2"): 1, (2, "w1 w2"): 1, (2, "w9 w9"): 2}
