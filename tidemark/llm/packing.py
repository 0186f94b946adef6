"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become token ids with a closing id; longer ones than a sequence are cut. The
plan follows the linear grouping scheme (the asymptotic scheme for bin packing): large
lengths are sorted and split into groups of equal cardinality, every length rounded up to
its group's largest; the few rounded sizes are packed by configurations (a linear program
solved by column generation, whole multiplicities kept); actual pieces take the slots of
their group; what is left over and all small pieces are placed by best-fit, largest first,
into the tightest gap.

Scale: lengths are integers up to the capacity, so the count of pieces per length (at
most ``capacity`` rows, whatever the corpus) is all that the plan needs; it is made on the
driver and says, as runs, which ranks of a length go to which sequences and offsets. Runs
are bounded by the lengths, not the documents, and are broadcast. The pieces themselves
stay distributed: a piece's rank among those of its length is its position in its own
partition plus an offset per (length, partition), so no length is ever ranked by one task.

Defined results: a null or empty text is the closing id alone; repeated rows and ids are
packed as separate pieces; very long texts are cut into pieces, none is dropped; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship
from tidemark.session import materialize

CACHE_WORDS = 800_000
#: Latin letters with a composed lower case of their own, then ASCII marks that no contraction starts with.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level models write for each byte (published with them)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Token ids of a text as little-endian 32-bit bytes, from a lower-casing tokenizer that never looks across white space.

    Special tokens written in a text get their own ids, as the library's plain call gives them. Pieces never cross ASCII white space, so ids are found once per distinct
    blank-separated word and kept in a bounded table. A plain word (Latin letters, then
    marks) is two of its pieces at most, which go to the model directly; every other word
    goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
            ids = self.pieces[piece] = array("I", [t.id for t in self.tok.model.tokenize(written)]).tobytes()
        return ids

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, words
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = {"": b""}
        other = []
        for word in new:
            text = word.decode()
            m = PLAIN.fullmatch(text)
            if m:
                self.known[word] = self.piece(m[1].lower()) + self.piece(m[2])
            else:
                other.append((word, text))
        for at in range(0, len(other), 20_000):
            part = other[at:at + 20_000]
            for (word, _), e in zip(part, self.tok.encode_batch_fast([t for _, t in part], add_special_tokens=False)):
                self.known[word] = array("I", e.ids).tobytes()

    def __call__(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


_tokenizers: dict[str, WordTokenizer] = {}  # of a Python worker: kept from task to task


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")
    width = 4 * capacity

    def run(batches):
        tok = _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            tok.learn(set().union(*texts))
            row, piece, length, crc, at, ids = [], [], [], [], [], []
            for i, words in enumerate(texts):
                whole = tok(words) + end
                for k, s in enumerate(range(0, len(whole), width)):
                    cut = whole[s:s + width]
                    n = len(cut) // 4
                    row.append(i)
                    piece.append(k)
                    length.append(n)
                    crc.append(zlib.crc32(cut))
                    at.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
            k = pa.array(piece, pa.int32())
            length = pa.array(length, pa.int64())
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), k,
                    pa.array([x * capacity for x in piece], pa.int64()), length, pa.array(crc, pa.int64()),
                    pa.array([part] * len(row), pa.int32()), pa.array(at, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
             end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, and ``ids`` if asked for), written out once.

    ``part`` and ``at`` give a piece's position among those of its length in its partition.
    """
    ship(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", thin.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()),
                           T.StructField("at", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return materialize(thin.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema))


# ---- the plan, from counts per length --------------------------------------------------


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, largest first, in ``groups`` groups of equal cardinality: lists of (length, count).
    With no more lengths than groups each is its own group (nothing is rounded)."""
    sizes = sorted(counts, reverse=True)
    if len(sizes) <= groups:
        return [[(s, counts[s])] for s in sizes]
    per = -(-sum(counts.values()) // groups)
    out: list = [[]]
    room = per
    for s in sizes:
        n = counts[s]
        while n:
            if not room:
                out.append([])
                room = per
            take = min(n, room)
            out[-1].append((s, take))
            n, room = n - take, room - take
    return out


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 3000) -> list[tuple[int, list[int]]]:
    """(multiplicity, count per size): whole multiplicities of an optimal basis of the
    configuration program min sum(x), sum(config * x) >= need, by column generation."""
    n, r = len(sizes), np.array(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    reach = np.arange(capacity + 1)[None, :] - r[:, None]
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        best, took = np.zeros(capacity + 1), []
        for _k in range(capacity // int(r.min())):
            value = np.where(reach >= 0, price[:, None] + best[np.maximum(reach, 0)], -1.0)
            which = value.argmax(axis=0)
            top = value[which, np.arange(capacity + 1)]
            better = top > best + 1e-12
            took.append(np.where(better, which, -1))
            if not better[capacity:].any() and not better.any():
                break
            best = np.where(better, top, best)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(n), capacity
        for layer in reversed(took):
            if layer[c] >= 0:
                column[layer[c]] += 1
                c -= sizes[layer[c]]
        x, d = inverse @ need, inverse @ column
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, ratio.argmin()] = column
    x = np.linalg.solve(basis, need)
    return [(int(x[j] + 1e-9), [int(round(v)) for v in basis[:, j]]) for j in range(n) if x[j] >= 1 - 1e-9]


def _take(queue: list, n: int) -> list[tuple[int, int]]:
    """Up to ``n`` pieces from the front of a group's queue, as (length, count)."""
    out = []
    while n and queue:
        s, k = queue[0]
        took = min(k, n)
        out.append((s, took))
        n -= took
        if took == k:
            queue.pop(0)
        else:
            queue[0] = (s, k - took)
    return out


def _substitute(multiple: int, slots: list[list[tuple[int, int]]]):
    """Sequences of one configuration with the actual lengths in its slots: (multiplicity, lengths)."""
    cuts = {0, multiple}
    for runs in slots:
        cuts.update(np.cumsum([k for _, k in runs]).tolist())
    cuts = sorted(cuts)
    at, left = [0] * len(slots), [runs[0][1] if runs else 0 for runs in slots]
    for a, b in zip(cuts, cuts[1:]):
        lengths = []
        for i, runs in enumerate(slots):
            if at[i] < len(runs):
                lengths.append(runs[at[i]][0])
                left[i] -= b - a
                if not left[i]:
                    at[i] += 1
                    left[i] = runs[at[i]][1] if at[i] < len(runs) else 0
        yield b - a, lengths


def _best_fit(bins: dict[int, list], counts: dict[int, int], capacity: int) -> None:
    """Place pieces, largest first, each into the tightest gap. ``bins``: gap -> [(multiplicity, [(length, copies)])]."""
    gaps = sorted(g for g in bins if bins[g])

    def put(gap, multiple, content):
        if not bins.get(gap):
            bins[gap] = []
            bisect.insort(gaps, gap)
        bins[gap].append((multiple, content))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                multiple, content = bins[gap].pop()
                if not bins[gap]:
                    gaps.pop(i)
            else:
                gap, content = capacity, []
                multiple = -(-left // (capacity // length))
            copies = min(gap // length, left)
            full = min(multiple, left // copies)
            put(gap - copies * length, full, [*content, (length, copies)])
            left -= full * copies
            rest = multiple - full
            if rest and left and left < copies:  # one sequence takes the last few
                put(gap - left * length, 1, [*content, (length, left)])
                left, rest = 0, rest - 1
            if rest and content:
                put(gap, rest, content)


def _scheme(counts: dict[int, int], capacity: int, groups: int, small: int) -> dict[int, list]:
    """Sequences by gap: (multiplicity, [(length, copies)]). Lengths above ``small`` are the large ones."""
    bins: dict[int, list] = defaultdict(list)
    if counts.get(capacity):
        bins[0].append((counts[capacity], [(capacity, 1)]))
    large = {s: n for s, n in counts.items() if small < s < capacity}
    left: dict[int, int] = defaultdict(int, {s: n for s, n in counts.items() if s <= small})
    if large:
        by_size: dict[int, list] = {}  # groups rounded to one length are one size
        for q in linear_groups(large, groups):
            by_size.setdefault(q[0][0], []).extend(q)
        sizes, queues = list(by_size), list(by_size.values())
        for multiple, config in configurations(sizes, [sum(k for _, k in q) for q in queues], capacity):
            slots = [g for g, n in enumerate(config) for _ in range(n)]
            # the smallest slot is left open: best-fit finds it a piece of the gap that the actual lengths leave
            taken = [_take(queues[g], multiple) for g in slots[:-1] or slots]
            for m, lengths in _substitute(multiple, taken):
                if lengths:
                    bins[capacity - sum(lengths)].append((m, [(s, 1) for s in lengths]))
        for s, k in (x for q in queues for x in q):
            left[s] += k
    _best_fit(bins, left, capacity)
    return bins


def plan(counts: dict[int, int], capacity: int = 2048, groups: int = 64) -> np.ndarray:
    """Runs (length, first rank, pieces, copies, first sequence, offset): the piece of rank r in a
    run is copy (r - first) % copies of sequence first sequence + (r - first) // copies.

    Where large ends is the scheme's free parameter; of an eighth, a quarter and half of
    the capacity the one with the fewest sequences counts.
    """
    tried = [_scheme(counts, capacity, groups, capacity // k) for k in (8, 4, 2)]
    bins = min(tried, key=lambda b: sum(m for kind in b.values() for m, _ in kind))
    ranks, sequence, runs = defaultdict(int), 0, []
    for gap in sorted(bins):
        for multiple, content in bins[gap]:
            offset = 0
            for s, copies in content:
                runs.append((s, ranks[s], multiple * copies, copies, sequence, offset))
                ranks[s] += multiple * copies
                offset += s * copies
            sequence += multiple
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def _assign(runs):
    def run(batches):
        table = runs.value
        key = (table[:, 0] << 48) + table[:, 1]  # lengths below 2**15, ranks below 2**48
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            nth = rank - r[:, 1]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(r[:, 4] + nth // r[:, 3]), pa.array(r[:, 5] + nth % r[:, 3] * length)],
                [*keep, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
         end_id: int = 0, groups: int = 64, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    spark = docs.sparkSession
    pieces = tokenize(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids)
    sizes = materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = spark.sparkContext.broadcast(plan(counts, capacity, groups))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts, ["length", "part"]).withColumn("rank", F.col("at") + F.col("shift"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*cols, "rank")
    schema = T.StructType([*(ranked.schema[c] for c in cols), T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_assign(runs), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the training rows of ``pack(..., with_ids=True)``; at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
