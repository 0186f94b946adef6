"""SimHash near-dedup: fingerprints, links at a small bit distance, components.

A 64-bit fingerprint sums the bits of every word shingle's XXH64. Fingerprints within
``max_bits`` differing bits are linked by a byte-position inverted index with count
filtering: two fingerprints that differ in at most 2 bits share at least 6 of their 8
positional bytes, so of the four positional byte pairs they share two at least. Every
distinct fingerprint is posted under each choice of two positional byte pairs (6 postings),
pairs in a posting list are tallied on all 8 bytes, those that reach the 6 guaranteed
matches are verified by their bit distance.

Scale: exact copies collapse to one distinct fingerprint before anything is posted, so a
group of copies never meets itself. A posting list of up to ``max_list`` fingerprints is
tallied pairwise. Fingerprints of longer lists (families of near copies) are linked
without pairs and without loss: each is listed under itself and its 64 one-bit
neighbours; two fingerprints within 2 bits always share such a value, all under one value
are within 2 bits of each other, and a value has at most 65 of them, so a star per value
keeps every component. Components are found on the links of distinct fingerprints.

Defined results: null and empty texts have fingerprint zero, linked like any other; rows
of one id count as one document for the smallest id, each with its own fingerprint; a
null id is never a component's smallest id unless the component has no other; texts are taken whole at any
length; an empty table gives no rows; other columns are not read by ``near_duplicates`` and stay as they
were in ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import connected_components, let, ship
from tidemark.session import materialize

SEED = 42
CHUNK = 4096  # shingles whose bits are unpacked at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the text's word shingles (0 without words)."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    hashes = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        bits = np.unpackbits(np.frombuffer(hashes[8 * at:8 * (at + CHUNK)], np.uint8))
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            fp = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) for every row."""
    ship(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", thin.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return thin.mapInArrow(_fingerprints(shingle), schema)


def _byte(c, i):
    return F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))


def _shared_bytes(x, y):
    return sum(((_byte(x, i) == _byte(y, i)).cast("int") for i in range(1, 8)), (_byte(x, 0) == _byte(y, 0)).cast("int"))


def links(distinct: DataFrame, max_bits: int = 2, max_list: int = 64) -> DataFrame:
    """(a, b) links among the distinct fingerprints ``fp``; see the module's text."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two shared byte pairs are guaranteed up to 2 differing bits")
    pair = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.lit(k << 32) + F.shiftleft(pair[i], 16) + pair[j] for k, (i, j) in enumerate(combinations(range(4), 2))]
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    listed = materialize(postings.join(sizes, "key"))
    need = 8 - max_bits

    def tallied(fps):
        return F.flatten(F.transform(fps, lambda x, i: F.transform(
            F.filter(F.slice(fps, i + 2, F.size(fps)),
                     lambda y: (_shared_bytes(x, y) >= need) & (F.bit_count(x.bitwiseXOR(y)) <= max_bits)),
            lambda y: F.struct(x.alias("a"), y.alias("b")))))

    short = (listed.where(F.col("n") <= max_list).groupBy("key").agg(F.collect_list("fp").alias("fps"))
             .select(F.explode(let(F.col("fps"), tallied)).alias("s")).select("s.a", "s.b"))
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64))) \
        if max_bits == 2 else F.array(F.col("fp"))
    stars = (listed.where(F.col("n") > max_list).select("fp").distinct().select("fp", F.explode(near).alias("value"))
             .groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
             .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))
    if max_bits == 1:  # a value and its neighbours: linked where the neighbour exists
        flips = F.array(*(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
        big = listed.where(F.col("n") > max_list).select("fp").distinct()
        stars = big.select(F.col("fp").alias("a"), F.explode(flips).alias("b")).join(big.select(F.col("fp").alias("b")), "b").select("a", "b")
    return short.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2, max_list: int = 64) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable over the links."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    nodes = connected_components(links(distinct.select("fp"), max_bits, max_list))
    rooted = materialize(nodes.join(distinct.withColumnRenamed("fp", "node"), "node").select("node", "root", "first_id"))
    roots = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("least_id")))
    linked = rooted.join(roots, "root").select(F.col("node").alias("fp"), "least_id")
    classes = materialize(distinct.join(linked, "fp", "left").where((F.col("n") > 1) | F.col("least_id").isNotNull())
                          .select("fp", F.coalesce("least_id", "first_id").alias("class_id")))
    return fps.join(classes, "fp", "left").select("id", "fp", F.coalesce("class_id", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_bits: int = 2) -> DataFrame:
    """The rows of the document with the smallest id of each component; all columns as they were.

    Rows of one id stay or go together (they go if every one of them has a smaller id in
    its component). A row without an id cannot be named, so it stays.
    """
    judged = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    gone = (judged.where(F.col("id").isNotNull()).groupBy("id").agg(F.bool_and(F.col("component_id") < F.col("id")).alias("goes"))
            .where("goes").select(F.col("id").alias("gone_id")))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_key"))
    return rows.join(gone, rows["doc_key"] == gone["gone_id"], "left_anti").select("doc.*")
