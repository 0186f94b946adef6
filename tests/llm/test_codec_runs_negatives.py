"""Byte-level BPE, periodic runs and hard negatives on awkward rows, hostile shapes, hot groups and empty tables."""

import base64
import os
import random
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from test_edges import awkward, same  # noqa: E402

from tidemark.llm import byte_bpe, hard_negatives, periodic_runs  # noqa: E402
from tidemark.llm.queries import tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, public_tokenizers.PATTERN, ranks


def test_codec_round_trip(spark, bpe):
    path, pattern, ranks = bpe
    df, rows = awkward(spark)
    back = byte_bpe.decode(byte_bpe.encode(df, path, pattern), path, pattern)
    assert back.columns == [*df.columns, "ids", "decoded"]
    got = back.select("doc_id", "ids", "decoded").collect()
    short = [r for r in rows if len(r[1] or "") < 20_000]
    same([(r.doc_id, r.ids, bytes(r.decoded)) for r in got if len(r.decoded) < 20_000],
         [(d, brute.byte_pair_ids(t, ranks, pattern), (t or "").encode()) for d, t in short])
    same([(r.doc_id, bytes(r.decoded)) for r in got], [(d, (t or "").encode()) for d, t in rows])
    empty, _ = awkward(spark, [])
    assert byte_bpe.encode(empty, path, pattern).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(df.withColumn("ids", F.lit(1)), path, pattern)


def test_codec_decodes_parts_of_characters(spark, bpe):
    path, pattern, ranks = bpe
    ids = [ranks[bytes([b])] for b in "é😀".encode()]
    df = spark.createDataFrame([(ids[:1],), (ids[1:4],), (None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(df, path, pattern).collect()] == ["é😀".encode()[:1], "é😀".encode()[1:4], b"", b""]


@pytest.mark.parametrize("part,blank", [(7, 3), (1, 2), (1 << 16, 1 << 14)])
def test_codec_safe_boundaries(bpe, monkeypatch, part, blank):
    """Cut anywhere safe, a text has the ids of the text encoded at once."""
    import re
    path, pattern, _ = bpe
    monkeypatch.setattr(byte_bpe, "PART", part)
    monkeypatch.setattr(byte_bpe, "LONG_BLANK", blank)
    monkeypatch.setattr(byte_bpe, "_BLANKS", re.compile(f"[{byte_bpe.WHITE}]{{{blank},}}"))
    codec, rng = byte_bpe.Codec(byte_bpe.load_ranks(path), pattern), random.Random(part)
    some = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "’", "1", "é", "中", "😀", "\x1c", "\x85", "　", "=", "​", "don't"]
    for _ in range(2000):
        text = "".join(rng.choices(some, k=rng.randrange(0, 40)))
        assert codec.encode(text).tolist() == codec.tok.encode_ordinary(text), text


@pytest.mark.parametrize("text", [" " * 10**6, " " * 10**6 + "x", "x" + "\n" * 10**6 + " y", "a" * 10**6, "a " * 10**6, "中" * 300_000, "=" * 10**6])
def test_codec_hostile_long_texts(bpe, text):
    path, pattern, _ = bpe
    codec = byte_bpe.Codec(byte_bpe.load_ranks(path), pattern)
    began = time.time()
    assert codec.decode(codec.encode(text).tolist()) == text.encode()
    assert time.time() - began < 10


def random_words(rng):
    kind, n, letters = rng.randrange(4), rng.randrange(0, 120), "abcdefgh"[:rng.choice([1, 2, 2, 3, 5])]
    if kind == 0:
        return rng.choices(letters, k=n)
    if kind == 1:
        out = []
        while len(out) < n:
            out += (rng.choices(letters, k=rng.randrange(1, 12)) * rng.randrange(1, 9))[:rng.randrange(1, 80)]
        return out
    if kind == 2:  # periodic stretches inside the period of a run
        inner = rng.choices("ab", k=rng.randrange(1, 4)) * rng.randrange(1, 6) + rng.choices("abc", k=rng.randrange(0, 3))
        return rng.choices("abc", k=rng.randrange(0, 9)) + inner * rng.randrange(1, 7) + rng.choices("abc", k=rng.randrange(0, 9))
    x, y = "a", "ab"  # the Fibonacci word has the most repeats below four periods
    for _ in range(rng.randrange(1, 8)):
        x, y = y, y + x
    return list(y[:200]) * rng.choice([1, 1, 4, 5])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("group_words", [1, 100, 1 << 17])
def test_runs_of_random_words(seed, group_words):
    rng = random.Random(seed)
    words = [random_words(rng) for _ in range(150)]
    runs, kept = periodic_runs.runs_of_texts([" ".join(w) for w in words], group_words=group_words)
    for w, got, text in zip(words, runs, kept):
        want = brute.runs(w)
        assert [tuple(map(int, r)) for r in got] == want, w
        assert text.decode() == brute.collapsed(w, want)


@pytest.mark.parametrize("words,n_runs", [(["a"] * 200_000, 1), (["a", "b"] * 150_000, 1), ((["x"] * 5 + ["y"]) * 50_000, 1),
                                          (["w%d" % i for i in range(200_000)], 0)])
def test_runs_of_hostile_long_texts(words, n_runs):
    began = time.time()
    runs, _ = periodic_runs.runs_of_texts([" ".join(words)])
    assert len(runs[0]) == n_runs and time.time() - began < 20


def test_runs_of_awkward_rows(spark):
    df, rows = awkward(spark, [(i, t, "en", "s") for i, t in enumerate([None, "", " \n", "a a a a a a", "a " * 5, "x y " * 4 + "x", "A a " * 9, "  " * 6,
                                                                          "one", "t" * 9000, "p q r " * 40 + "z " * 7, "b\x0bb\x0cb\tb\rb\nb"])])
    got = periodic_runs.detect(periodic_runs.with_made_runs(df))
    assert got.select("doc.*").columns == df.columns
    have = got.select("doc.doc_id", F.transform("runs", lambda r: F.array(r["start"], r["length"], r["period"])).alias("runs"), "collapsed").collect()
    want = []
    for d, t in rows:
        w = brute.made_runs(d, t)
        want.append((d, [list(r) for r in brute.runs(w)], brute.collapsed(w, brute.runs(w))))
    same(have, want)
    empty, _ = awkward(spark, [])
    assert periodic_runs.detect(periodic_runs.with_made_runs(empty)).count() == 0


SCHEMA = "vec_id long, embedding array<float>, label int"


def mined(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("numbers", "norm", "cell", "anchor", "rank")}).repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, label, **options).collect()]


def vectors(n, seed, dims=6, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(i, [float(np.float32(x)) for x in centres[rng.integers(6)] + spread * rng.normal(size=dims)], int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"max_anchors": 3}, {"n_directions": 1, "sample_rows": 2}, {"n_positives": 2, "n_negatives": 7}])
def test_negatives(spark, options):
    rows = vectors(600, 1)
    same(mined(spark, rows, **options), brute.hard_negatives(rows, **{k: v for k, v in options.items() if k in ("n_positives", "n_negatives")}))


def test_negatives_hot_copies(spark):
    """A third of the rows is one vector: all its scores tie."""
    rows = vectors(400, 2)
    rows = [(i, rows[3][1] if i % 3 == 0 else v, y) for i, v, y in rows]
    same(mined(spark, rows), brute.hard_negatives(rows))


def test_negatives_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(130, 3, dims=3)
    rows += [(0, rows[0][1], rows[0][2]), (50, [0.5, 0.25], 1), (50, [0.5, 0.25], 1), (50, [], 2), (100, [0.0, 0.0, 0.0], 0), (151, [0.0] * 3, 0), (152, [], 1),
             (None, [1.0, 1.0, 1.0], 1), (153, None, 1), (154, [1.0, None, 1.0], 1), (155, [nan, 1.0, 1.0], 1), (200, [inf, 1.0, 1.0], 1), (156, [1.0, 1.0, 1.0], None),
             (157, [1.0, 1.0, 1.0, 1.0, 9.0], 1), (-50, [-1.0, 2.0, 3.0], 2), (-7, [1.0, 2.0, -3.0], 9)]
    # the brute-force version takes floor modulo; so do the rows with an id below zero: -7 % 7 = 0, -50 % 50 = 0
    same(mined(spark, rows), brute.hard_negatives(rows))
    assert mined(spark, [], SCHEMA) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_negatives_large_numbers(spark):
    """Scores beyond what floating point sums exactly."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.uniform(-1.5e6, 1.5e6, 4)], int(rng.integers(2))) for i in range(160)]
    same(mined(spark, rows, "vec_id long, embedding array<double>, label int"), brute.hard_negatives(rows))
    big = [*rows, (161, [1e9, 0.0, 0.0, 0.0], 0), (162, [1e300, 0.0, 0.0, 0.0], 1)]
    same(mined(spark, big, "vec_id long, embedding array<double>, label int"), brute.hard_negatives(rows))


def test_bounds_hold_every_score():
    """Triangle bounds of stretches of rows, copies and opposites of the anchors included."""
    rng = np.random.default_rng(4)
    m = np.floor(256 * np.concatenate([rng.normal(size=(300, 5)), np.repeat(rng.normal(size=(3, 5)), 30, axis=0), np.zeros((5, 5))]))
    m = np.concatenate([m, -m[:100], 3 * m[:50]])
    norms = np.linalg.norm(m, axis=1)
    directions = rng.normal(size=(7, 5))
    directions /= np.linalg.norm(directions, axis=1)[:, None]
    angles = hard_negatives._angles(m, norms, directions).astype(np.float32)
    rows = hard_negatives.Rows({"vec_id": range(len(m)), "label": [0] * len(m), "numbers": [x.astype("<i4").tobytes() for x in m], "norm": norms, "angles": angles}, 5)
    scores = m @ m.T
    for width in (1, 4, 64):
        cuts = np.arange(0, len(m), width)
        a = rows.angles
        low, high = hard_negatives._bounds(np.minimum.reduceat(a, cuts), np.maximum.reduceat(a, cuts), np.minimum.reduceat(norms, cuts), np.maximum.reduceat(norms, cuts), rows)
        assert (low <= np.minimum.reduceat(scores, cuts, axis=1)).all() and (high >= np.maximum.reduceat(scores, cuts, axis=1)).all()
        assert width > 1 or (high - low < 2 * np.outer(norms, norms) - 1).mean() > 0.5
