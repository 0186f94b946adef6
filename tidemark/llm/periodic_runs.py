"""Periodic run detection: maximal stretches of words that repeat with a small period.

A run is a stretch with smallest period q (words q apart are identical) of at least
``max(min_words, min_periods * q)`` words that no neighbouring word extends. Runs come from internal
pattern matching:

* The words of a text are numbered and a suffix array is made by prefix doubling. Every
  round's ranks name the substrings of 2**k words, so they also give each such block's
  suffix-array interval and, from the largest round down, the longest common extension of
  two positions to the right or left.
* A wavelet tree over the suffix array answers "the next occurrence of this block after
  position x" (range successor) as a rank and a selection.
* Dyadic blocks: a run with period q holds an aligned block of m words and its copy q words
  on, where m is the power of two with (2m-1)/3 <= q < (4m-1)/3 (from m = 2 on). So every aligned block
  asks for its occurrences in the window of that many positions after it.
* Occurrences at a distance of at most m/4 form an arithmetic progression, whose difference is a period
  of the block. Of a whole progression one distance can be the smallest period of a run
  round it: that between the ends of the block's own periodic stretch and the
  progression's. Other occurrences give their distance. So a window costs a few successors.
* Every candidate is extended both ways, kept if long enough, and of candidates for one
  stretch the smallest period stays.

Each step is one numpy operation for all blocks of a level of many texts: the texts of an
Arrow batch are put side by side (texts of like length together, ``group_words`` words at
most unless one text is longer) with numbers of their own for each text's words, so nothing is found across
texts and the work does not depend on what other texts hold. A text of n words takes
O(n log n) memory and O(n log**2 n) time, whatever its repeats.

Scale: one pass over the rows, no shuffle.

Defined results: null, empty and white-space texts have no words and no runs, and collapse
to the empty text; words are whatever is between ASCII white space, compared as they are; texts are
taken whole at any length; repeated rows stay repeated; an empty table gives no rows; the
other columns stay as they were in the struct ``doc``, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD_SPACE, let, ship

GROUP_WORDS = 1 << 17
RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


class _Ranks:
    """Prefix doubling: ``levels[k][i]`` is the suffix-array place of the first suffix with the 2**k words at i."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        counts = np.bincount(symbols)
        rank = (np.cumsum(counts) - counts)[symbols].astype(np.int32)
        self.order = np.argsort(symbols, kind="stable").astype(np.int32)
        self.levels = [rank]
        active = counts[symbols] > 1  # suffixes that share their rank, in text order
        places = np.flatnonzero(active[self.order])  # and where they stand in the suffix array
        while len(places):
            step = 1 << (len(self.levels) - 1)
            at = self.order[places].astype(np.int64)
            after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
            key = rank[at].astype(np.int64) * (n + 1) + after + 1
            by = np.argsort(key, kind="stable")
            key, at = key[by], at[by]
            self.order[places] = at
            new = np.flatnonzero(np.diff(key, prepend=-1))
            size = np.diff(new, append=len(key))
            rank = rank.copy()
            rank[at] = np.repeat(places[new], size)
            self.levels.append(rank)
            places = places[np.repeat(size > 1, size)]

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j share from there on."""
        n, out = len(self.order), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i + out, j + out
            same = (a < n) & (b < n)
            same[same] = self.levels[k][a[same]] == self.levels[k][b[same]]
            out[same] += 1 << k
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are the same before i and before j."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - (1 << k), j - out - (1 << k)
            same = (a >= 0) & (b >= 0)
            same[same] = self.levels[k][a[same]] == self.levels[k][b[same]]
            out[same] += 1 << k
        return out


class _WaveletTree:
    """Ranks and selections over ranges of a sequence of small numbers."""

    def __init__(self, values: np.ndarray):
        self.bits = int(values.max()).bit_length() if len(values) else 0
        self.zeros, self.split = [], []
        for b in range(self.bits - 1, -1, -1):
            low = (values >> b & 1) == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(low, out=before[1:])
            self.zeros.append(before)
            self.split.append(int(before[-1]))
            values = np.concatenate([values[low], values[~low]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at lo..hi-1 are less than x."""
        out = np.where(x >= 1 << self.bits, hi - lo, 0)
        lo, hi = lo.copy(), hi.copy()
        for k, zeros in enumerate(self.zeros):
            zl, zh = zeros[lo], zeros[hi]
            one = (x >> (self.bits - 1 - k) & 1) == 1
            out += np.where(one & (x < 1 << self.bits), zh - zl, 0)
            lo = np.where(one, self.split[k] + lo - zl, zl)
            hi = np.where(one, self.split[k] + hi - zh, zh)
        return out

    def nth(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The value with ``nth`` smaller ones among those at lo..hi-1."""
        out, nth, lo, hi = np.zeros(len(lo), np.int64), nth.copy(), lo.copy(), hi.copy()
        for k, zeros in enumerate(self.zeros):
            zl, zh = zeros[lo], zeros[hi]
            one = nth >= zh - zl
            nth = np.where(one, nth - (zh - zl), nth)
            out = out * 2 + one
            lo = np.where(one, self.split[k] + lo - zl, zl)
            hi = np.where(one, self.split[k] + hi - zh, zh)
        return out


class _Blocks:
    """Occurrences of the blocks of one dyadic level, by range successor in their suffix-array intervals."""

    def __init__(self, at, rank, group_size, first_word, tree):
        self.lo = rank[at].astype(np.int64)
        self.hi = self.lo + group_size[self.lo]
        self.base = first_word[at]  # the tree holds positions inside their text
        self.tree = tree

    def after(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The next occurrence behind x of the block of each row, -1 if there is none."""
        lo, hi, base = self.lo[rows], self.hi[rows], self.base[rows]
        nth = self.tree.below(lo, hi, x - base + 1)
        some = lo + nth < hi
        out = np.full(len(rows), -1, np.int64)
        out[some] = base[some] + self.tree.nth(lo[some], hi[some], nth[some])
        return out


def _candidates(ranks: _Ranks, first_word: np.ndarray, longest: int, min_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) pairs: each run has one with a position inside it and its period."""
    n = len(ranks.order)
    tree = _WaveletTree(ranks.order.astype(np.int64) - first_word[ranks.order])
    found = []
    for k in range(1, len(ranks.levels)):
        m = 1 << k
        least, beyond = (2 * m - 1 + 2) // 3 if k > 1 else 1, (4 * m - 1 + 2) // 3
        if min_periods * least > longest:
            break
        size = np.bincount(ranks.levels[k], minlength=n)
        start = np.arange(0, n, m)
        start = start[size[ranks.levels[k][start]] > 1]
        blocks = _Blocks(start, ranks.levels[k], size, first_word, tree)
        rows, x = np.arange(len(start)), start
        while len(rows):
            s = blocks.after(rows, x)
            near = (s >= 0) & (s - start[rows] < beyond)
            rows, s = rows[near], s[near]
            t = blocks.after(rows, s)
            chain = (t >= 0) & (t - s <= m // 4)
            found.append((start[rows[~chain]], s[~chain]))
            x = s.copy()
            if chain.any():
                at, s, t = start[rows[chain]], s[chain], t[chain]
                d = t - s
                end, own_end = t + ranks.right(s, t), at + d + ranks.right(at, at + d)
                found.append((at, at + end - own_end))
                x[chain] = np.maximum(end - m, s)
            # an occurrence by itself goes on from there, a progression behind its last one
    at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    period = np.concatenate([f[1] for f in found]) - at if found else at
    return at[period > 0], period[period > 0]


def find_runs(symbols: np.ndarray, offsets: np.ndarray, min_words: int = 6, min_periods: int = 4) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    symbols: small numbers, no number in two texts; offsets: where each text begins, and the end.
    """
    if min_periods < 4:
        raise ValueError("blocks and windows are laid out for runs of four periods or more")
    lengths = np.diff(offsets)
    none = np.zeros((0, 4), np.int64)
    if not len(symbols):
        return none
    text = np.repeat(np.arange(len(lengths)), lengths)
    ranks = _Ranks(symbols)
    at, period = _candidates(ranks, offsets[:-1][text].astype(np.int64), int(lengths.max()), min_periods)
    if not len(at):
        return none
    pairs = np.unique(np.stack([at, period]), axis=1)
    at, period = pairs
    inside = at + period < len(symbols)
    at, period = at[inside], period[inside]
    start = at - ranks.left(at, at + period)
    end = at + period + ranks.right(at, at + period)
    long = end - start >= np.maximum(min_words, min_periods * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = (np.diff(start, prepend=-1) != 0) | (np.diff(end, prepend=-1) != 0)
    start, end, period = start[first], end[first], period[first]
    out = np.stack([text[start], start - offsets[:-1][text[start]], end - start, period], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _groups(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows by length, in groups of ``most`` words at most (one row at least)."""
    by = np.argsort(sizes, kind="stable")
    group, words = [], 0
    for i in by:
        if group and words + sizes[i] > most:
            yield np.array(group)
            group, words = [], 0
        group.append(i)
        words += sizes[i]
    if group:
        yield np.array(group)


def _numbered(words: list[bytes], first: int) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64) + first


def runs_of_texts(texts: list[str | None], min_words: int = 6, min_periods: int = 4, group_words: int = GROUP_WORDS):
    """For each text its runs (rows of start, length, period) and the text without repeats."""
    words = [(t or "").encode().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    runs, kept = [np.zeros((0, 3), np.int64)] * len(texts), [b""] * len(texts)
    for group in _groups(sizes, group_words):
        offsets = np.zeros(len(group) + 1, np.int64)
        np.cumsum(sizes[group], out=offsets[1:])
        symbols = np.zeros(offsets[-1], np.int64)
        first = 0
        for g, i in enumerate(group):
            if sizes[i]:
                own = symbols[offsets[g]:offsets[g + 1]] = _numbered(words[i], first)
                first = int(own.max()) + 1
        found = find_runs(symbols, offsets, min_words, min_periods)
        # words of a run behind its first period, counted by where such stretches begin and end
        begin = offsets[found[:, 0]] + found[:, 1]
        drop = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(drop, begin + found[:, 3], 1)
        np.add.at(drop, begin + found[:, 2], -1)
        stays = np.cumsum(drop[:-1]) == 0
        cut = np.searchsorted(found[:, 0], np.arange(len(group) + 1))
        for g, i in enumerate(group):
            runs[i] = found[cut[g]:cut[g + 1], 1:]
            own = stays[offsets[g]:offsets[g + 1]]
            kept[i] = b" ".join(words[i] if own.all() else [words[i][k] for k in np.flatnonzero(own)])
    return runs, kept


def detect(docs: DataFrame, text_col: str = "text", min_words: int = 6, min_periods: int = 4,
           group_words: int = GROUP_WORDS) -> DataFrame:
    """(doc, n_words, runs, collapsed) for every row: the row as a struct, its words, its runs as an array of
    (start, length, period) by start and period, and the words joined by one blank without each run's repeats."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            runs, kept = runs_of_texts(texts, min_words, min_periods, group_words)
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], RUN.names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), parts), pa.array([k.decode() for k in kept], pa.string())],
                ["doc", "runs", "collapsed"])

    rows = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run with the greatest length (ties: smallest start, then period); null without runs."""
    def order(a, b):
        first = F.when(a["length"] != b["length"], b["length"] - a["length"]).when(a["start"] != b["start"], a["start"] - b["start"])
        return F.signum(first.otherwise(a["period"] - b["period"])).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def with_made_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's input: in one text of ten, by the CRC-32 of the id, the words from a place on repeat with a period.

    With h = crc32(decimal id), g = floor(h/10) and n words: if h%10 = 0 and n > 0, each word i >= a
    becomes word a+(i-a)%p, where a = g%n and p = 1+floor((n-a)/(3+g%8)). Others stay; a null id stays.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[^{WORD_SPACE}]+"), F.lit(0))

    def repeated(w):
        n = F.size(w).cast("long")
        g = F.floor(h / 10)
        return let(F.pmod(g, n), lambda a: let(
            1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))),
            lambda p: F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(
                F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")))

    made = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col(text_col)))
    return docs.withColumn(text_col, F.when(h % 10 == 0, made).otherwise(F.col(text_col)))
