"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items (an item
with fewer words is one pattern). Patterns of one length m are searched together: a shift
table indexed by the hash of a block of up to 3 words says how far the next possible
match end is (m - block + 1 where the block is in no pattern, so most positions are never
looked at); at shift 0 the bucket of the window's last block, checked against its first
block, selects the patterns, and a comparison of the words themselves confirms. All windows
of an Arrow batch advance together as numpy arrays.

Scale: documents are read once and never shuffled. The benchmark is the stated query set:
it is compiled in blocks of at most ``block_bytes`` of item text, each broadcast on its
own; every block sees all documents. With several blocks the rows are checkpointed
between them.

Defined results: a null text has no words; an item without words never occurs; null item
ids count as the text "null"; items that share an id count once; repeated documents are
judged one by one; texts are taken whole at any length; an empty document table gives no rows, an empty
benchmark leaves every document clean; other columns are carried unread, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship
from tidemark.llm.words import Hasher, lowered, spans
from tidemark.session import materialize

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SLOT_BITS = 18
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)


def _fold(columns) -> np.ndarray:
    """One hash of several word-hash arrays, in order."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c) * _STEP
        out ^= out >> np.uint64(29)
    return out


def _slots(block: np.ndarray) -> np.ndarray:
    return (block * _MIX) >> np.uint64(64 - SLOT_BITS)


class Length:
    """Shift table and buckets of the patterns of one length."""

    def __init__(self, m: int, patterns: dict[tuple, set], hasher: Hasher):
        self.m, self.block = m, min(3, m)
        self.most = m - self.block + 1
        texts = [b" ".join(p) for p in patterns]
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        h = hasher(data, *spans(data)).reshape(-1, m)
        self.shift = np.full(1 << SLOT_BITS, self.most, np.uint8 if self.most < 256 else np.int32)
        for end in range(self.block - 1, m):
            np.minimum.at(self.shift, _slots(self._block(h, end)), m - 1 - end)
        key = _fold([self._block(h, m - 1), self._block(h, self.block - 1)])
        order = np.argsort(key, kind="stable")
        self.key, self.texts = key[order], [texts[i] for i in order]
        items = list(patterns.values())
        self.items = [items[i] for i in order]

    def _block(self, h, end):
        return _fold([h[:, end - k] for k in range(self.block - 1, -1, -1)])

    def _at(self, h, ends):
        return _fold([h[ends - k] for k in range(self.block - 1, -1, -1)])

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Ends (word positions) whose last block ends some pattern."""
        at = np.arange(self.block - 1, len(h), self.most)
        last, found = np.minimum(at + self.most, len(h)), []
        while len(at):
            step = self.shift[_slots(self._at(h, at))].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            left = at < last
            at, last = at[left], last[left]
        ends = np.concatenate(found) if found else np.empty(0, np.int64)
        return ends[ends >= self.m - 1]

    def confirmed(self, data, starts, ends_of, h, of):
        """(first word, last word, items) of every occurrence."""
        ends = self.candidates(h)
        ends = ends[of[ends] == of[ends - self.m + 1]]
        key = _fold([self._at(h, ends), self._at(h, ends - self.m + self.block)]) if len(ends) else np.empty(0, np.uint64)
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        for i in np.flatnonzero(lo < hi):
            e = ends[i]
            words = slice(e - self.m + 1, e + 1)
            text = b" ".join(data[s:t].tobytes() for s, t in zip(starts[words], ends_of[words]))
            for k in range(lo[i], hi[i]):
                if self.texts[k] == text:
                    yield e - self.m + 1, e, self.items[k]


class Patterns:
    """The compiled patterns of one block of items: (item id, text) pairs."""

    def __init__(self, items, window: int):
        self.by_length: dict[int, dict[tuple, set]] = defaultdict(dict)
        for item, text in items:
            words = WORD.findall((text or "").encode().lower())
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                self.by_length[m].setdefault(tuple(words[i:i + m]), set()).add(str(item) if item is not None else "null")

    def compiled(self) -> tuple[Hasher, list[Length]]:
        hasher = Hasher()
        return hasher, [Length(m, p, hasher) for m, p in sorted(self.by_length.items())]


def search(texts: pa.Array, hasher: Hasher, lengths: list[Length]) -> tuple[list, list, list]:
    """Per text: number of words, merged spans of hit words, ids of the items found."""
    data, offsets = lowered(texts)
    starts, ends = spans(data)
    of = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(of, minlength=len(texts)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n_words)])
    hits, items = [[] for _ in texts], [set() for _ in texts]
    if len(starts) and lengths:
        h = hasher(data, starts, ends)
        for length in lengths:
            for s, e, found in length.confirmed(data, starts, ends, h, of):
                hits[of[s]].append((int(s - first[of[s]]), int(e - first[of[s]])))
                items[of[s]] |= found
    return n_words.tolist(), hits, items


def merged(found: list) -> list:
    out: list = []
    for s, e in sorted(found):
        if out and s <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], e)
        else:
            out.append({"first": s, "last": e})
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _scan(patterns, carried: list[str]):
    def run(batches):
        hasher, lengths = patterns.value.compiled()
        for b in batches:
            n, hits, items = search(b.column("text"), hasher, lengths)
            if "spans" in b.schema.names:
                for i, (s, x) in enumerate(zip(b.column("spans").to_pylist(), b.column("items").to_pylist())):
                    hits[i] += [(y["first"], y["last"]) for y in s]
                    items[i] |= set(x)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carried), pa.array(n, pa.int64()), pa.array([merged(x) for x in hits], _SPANS),
                 pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [*carried, "n_words", "spans", "items"])
    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """(list of (item id, text), whether it is the last); each of about ``block_bytes`` of text (or one item)."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):  # by hash of item and text: about equal blocks, an item's windows stay together
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item"], r["text"]) for r in part.collect()], k == n - 1


def find_contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                       block_bytes: int = 16 << 20) -> DataFrame:
    """Every row of ``docs``: ``doc`` (a struct of the ``carry`` columns), ``n_words``, ``spans`` (merged, of
    0-based positions of hit words) and ``items`` (sorted ids of the items found)."""
    spark = docs.sparkSession
    ship(spark)
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("doc"), F.col(text_col).alias("text"))
    judged = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS),
              T.StructField("items", T.ArrayType(T.StringType()))]
    for items, last in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        patterns = spark.sparkContext.broadcast(Patterns(items, window))
        carried = ["doc"] if last else ["doc", "text"]
        df = df.mapInArrow(_scan(patterns, carried), T.StructType([*(df.schema[c] for c in carried), *judged]))
        if not last:  # the next block reads the rows that this one has judged
            df = materialize(df)
    return df


def n_hit(spans_col: str = "spans"):
    return F.aggregate(spans_col, F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` with no hit word, with all their columns."""
    found = find_contamination(docs, benchmark, docs.columns, text_col, **params)
    return found.where(F.size("spans") == 0).select("doc.*")
