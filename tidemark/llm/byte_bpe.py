"""Byte-level BPE: texts to token ids by a local rank file, ids back to raw bytes.

Both ways are the tiktoken library's, with the ranks and the pre-splitting pattern given
by the caller; no special tokens. Long texts are pre-split at safe boundaries: a white-space
character after any other character always starts a new match of the pattern, so text cut
there has the same matches on both sides. A run of white space that is too long for the
pattern engine is cut out first, by the pattern's own rule: all of it is one match at the
end of a text, all but its last character elsewhere. Each match is merged on its own, as
the library does; no match is ever cut.

The pattern must be of the family that these rules hold for: matches hold white space only
as a single leading blank or as a whole run, as in ``public_tokenizers.PATTERN``.

Scale: one pass over the rows, no shuffle. The rank file (below a megabyte) is read once by
the driver and broadcast; ``max_rank_bytes`` bounds it.

Defined results: a null text has the ids of the empty text, none; ``decode`` of null ids is
empty, a null or unknown id inside a list is an error that names it; repeated rows stay
repeated; an empty table gives no rows; very long texts are encoded whole, in bounded
parts; the other columns stay as they were, and the new column must not clash with one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship

PART = 1 << 16  # characters that the library gets at a time, up to the next safe boundary
LONG_BLANK = 1 << 14  # characters of a run of white space from which it is cut out
#: The characters with the Unicode property White_Space, as a regex class body.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BLANKS = re.compile(f"[{WHITE}]{{{LONG_BLANK},}}")
_SAFE = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")


def load_ranks(path: str, max_rank_bytes: int = 64 << 20) -> bytes:
    """The rank file's bytes: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        data = f.read(max_rank_bytes + 1)
    if len(data) > max_rank_bytes:
        raise ValueError(f"{path} has more than {max_rank_bytes} bytes")
    return data


class Codec:
    def __init__(self, rank_file: bytes, pattern: str):
        import tiktoken
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
        self.tok = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known = ranks.values()

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part, whole_match in _parts(text):
            out += self.tok._encode_single_piece(part) if whole_match else self.tok.encode_ordinary(part)
        return np.array(out, np.int32)

    def decode(self, ids: list) -> bytes:
        try:
            return self.tok.decode_bytes(ids)
        except (KeyError, TypeError) as e:
            bad = next((i for i in ids if i not in self.known), None)
            raise ValueError(f"{bad!r} is not a token id") from e


def _parts(text: str) -> Iterator[tuple[str, bool]]:
    """Cuts of ``text`` at safe boundaries; True beside those that are one match as they stand."""
    at = 0
    if len(text) >= LONG_BLANK:
        for m in _BLANKS.finditer(text):
            yield from _short(text, at, m.start())
            at = m.end() if m.end() == len(text) else m.end() - 1
            yield text[m.start():at], True
    yield from _short(text, at, len(text))


def _short(text: str, at: int, end: int) -> Iterator[tuple[str, bool]]:
    while end - at > PART:
        m = _SAFE.search(text, at + PART, end)
        if not m:
            break
        yield text[at:m.start()], False
        at = m.start()
    if at < end:
        yield text[at:end], False


_codecs: dict[tuple, Codec] = {}  # of a Python worker: kept from task to task


def _codec(ranks, pattern: str) -> Codec:
    key = (ranks.value, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


def _mapped(df: DataFrame, col: str, out_col: str, out_type, rank_path: str, pattern: str, make) -> DataFrame:
    if out_col in df.columns:
        raise ValueError(f"the table has a column {out_col} already")
    spark = df.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(rank_path))

    def run(batches):
        codec = _codec(ranks, pattern)
        for batch in batches:
            made = [make(codec, x) for x in batch.column(1).to_pylist()]
            kind = pa.binary() if out_type == T.BinaryType() else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], ["row", "made"])

    wrapped = df.select(F.struct("*").alias("row"), F.col(col).alias("value"))
    schema = T.StructType([wrapped.schema["row"], T.StructField("made", out_type)])
    return wrapped.mapInArrow(run, schema).select("row.*", F.col("made").alias(out_col))


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text_col`` as an array of int."""
    return _mapped(df, text_col, out_col, T.ArrayType(T.IntegerType()), rank_path, pattern,
                   lambda codec, text: codec.encode(text or ""))


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes that ``ids_col`` stands for; the bytes need not be whole characters."""
    return _mapped(df, ids_col, out_col, T.BinaryType(), rank_path, pattern,
                   lambda codec, ids: codec.decode(ids or []))
