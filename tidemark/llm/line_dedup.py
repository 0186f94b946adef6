"""Line dedup: drop lines that many documents share, keep the rest in place.

Lines are normalised, hashed (128 bits) and exploded with their position; distinct
documents are counted per hash; lines whose hash is found in at least ``min_docs``
documents leave every document but the largest id holding them; the kept lines are put
together again by position.

Scale: only (id, position, hash) rows of long lines are shuffled for the counts, and
Spark's two-step distinct count spreads a line that a third of the documents hold. The
join of occurrences with the repeated hashes is between two plain exchanges, which
adaptive execution splits at a hot hash; a document's dropped positions are no more than
its lines. The texts move once, for the join on the id.

Defined results: a null or empty text is one empty line; a null id never counts as a
document nor as the largest holder, and its lines go as any other's; rows that share an
id count as one document; texts are taken whole at any length; an empty table gives no rows; other
columns are carried unread, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import let, ship
from tidemark.session import materialize

SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str, min_chars: int) -> list[tuple[int, bytes]]:
    """(position, key) of the lines whose key has ``min_chars`` code points at least."""
    out = []
    for at, line in enumerate(text.encode().split(b"\n")):
        key = line.strip(SPACE).lower()  # bytes.lower(): A-Z only
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            out.append((at, key))
    return out


def _occurrences(min_chars: int):
    def run(batches):
        for batch in batches:
            rows, at, keys = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for pos, key in line_keys(text or "", min_chars):
                    rows.append(i)
                    at.append(pos)
                    keys.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)), pa.array(at, pa.int32()),
                 pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["id", "row", "pos", "h1", "h2"])
    return run


def shared_line_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                          min_docs: int = 5) -> DataFrame:
    """(id, row, drop): the sorted positions that a text loses; ``row`` is the text's xxhash64, which tells
    apart different texts of one id or of none. Texts that lose nothing are absent."""
    ship(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", thin.schema["id"].dataType), T.StructField("row", T.LongType()),
                           T.StructField("pos", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
    occ = materialize(thin.mapInArrow(_occurrences(min_chars), schema))
    shared = materialize(occ.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"))
                         .where(F.col("n") >= min_docs).select("h1", "h2", "last"))
    lost = occ.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    return lost.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5) -> DataFrame:
    """One row per input row: ``doc`` (the input row as a struct), ``kept`` (its text without the dropped
    lines), ``n_lines`` and ``n_dropped``."""
    lost = shared_line_positions(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_key"), F.xxhash64(text_col).alias("text_key"))
    j = rows.join(lost, rows["doc_key"].eqNullSafe(lost["id"]) & (rows["text_key"] == lost["row"]), "left")
    j = j.withColumn("whole", F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")))  # behind the join: each text moves once
    lines = F.split("whole", "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    kept = let(lines, lambda ls: F.array_join(F.transform(keep, lambda i: F.get(ls, i)), "\n"))
    n_dropped = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(keep))
    kept = F.when(F.col("drop").isNull(), F.col("whole")).otherwise(kept)
    return j.select("doc", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"),
                    n_dropped.cast("long").alias("n_dropped"))


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                         min_docs: int = 5) -> DataFrame:
    """``docs`` with its columns, the text without the shared lines (null stays null); a column ``n_chars``
    counts the new text."""
    rows = dedup_lines(docs, id_col, text_col, min_chars, min_docs)
    text = F.when(F.col(f"doc.`{text_col}`").isNull(), F.lit(None).cast("string")).otherwise(F.col("kept"))
    new = {text_col: text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*((new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
