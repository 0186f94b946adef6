"""dictionary terms in free text by a word trie.

The dictionary becomes a trie of words, a table of steps that is walked from every word of a text as
far as it goes; the longest term from each word is the match, and a match inside another one is
dropped on the way, since an earlier match that reaches as far is known by then. No n-gram
leaves the scan, terms may have any number of words, and a text costs one step a word plus the
words of its matches.

A dictionary of up to ``block_bytes``, some hundred thousand terms, is collected, broadcast as a trie and settles
everything in one scan. A larger one stays distributed: a bitmap of hashes of the terms and of their beginnings,
of at most ``SIEVE_BITS`` bits, is broadcast instead and says which runs of words may be terms. Those
few are joined with the dictionary by the term, and the matches (not the texts) are brought
together per row to drop those inside a longer one. The texts are read once for a dictionary of any size; more terms
than the bitmap can tell apart let more runs through to the join, but change no result.

Words are maximal runs of letters, marks and digits of any script, lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

BLOCK_BYTES = 16 << 20
SIEVE_BITS = 1 << 29
BETWEEN_WORDS = r"[^\p{L}\p{M}\p{N}]+"


def words_text(text: Column) -> Column:
    """The words of a text, each between single blanks; null stays."""
    return F.trim(F.regexp_replace(F.lower(text), BETWEEN_WORDS, " "))


def _scan(trie):
    """Matches of the whole dictionary's trie: (row, term, n_hits)."""
    def run(batches):
        import pyarrow as pa
        first, steps, ends = trie.value
        for batch in batches:
            rows, sizes, terms = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words, reach, hits = (text or "").split(" "), 0, {}
                for start, word in enumerate(words):
                    node = first.get(word)
                    if node is None:
                        continue
                    end, at = 0, start + 1
                    while node is not None:
                        if node in ends:
                            end = at
                        node = steps.get((node, words[at])) if at < len(words) else None
                        at += 1
                    if end > reach:  # else there is none, or it lies inside an earlier one
                        reach = end
                        term = " ".join(words[start:end])
                        hits[term] = hits.get(term, 0) + 1
                rows += [row] * len(hits)
                terms += hits
                sizes += hits.values()
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(terms, pa.string()), pa.array(sizes, pa.int64())], ["row", "term", "n_hits"])
    return run


def _sieve(known: DataFrame, n_bits: int) -> bytes:
    """A bitmap of ``n_bits`` (a power of two) with the hash of every term, and of every beginning of one with a blank behind it."""
    words = F.split("term", " ")
    inner = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    begun = F.transform(inner, lambda i: F.concat(F.array_join(F.slice(words, 1, i), " "), F.lit(" ")))
    bits = known.select(F.explode(F.concat(F.array("term"), begun)).alias("k")).select(F.crc32(F.col("k").cast("binary")).bitwiseAND(n_bits - 1).alias("bit"))
    # the functions count bits from 1; a bucket holds 32768
    bits = bits.select(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket"), F.bitmap_bit_position(F.col("bit") + 1).alias("at"))
    maps = bits.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("map")).collect()
    out = bytearray(n_bits >> 3)
    for r in maps:
        out[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = r["map"]
    return bytes(out)


def _sifted(sieve, n_bits: int):
    """The runs of words that may be terms, by term: (row, n, term, starts)."""
    def run(batches):
        from zlib import crc32

        import pyarrow as pa
        bits, mask = sieve.value, n_bits - 1
        for batch in batches:
            rows, sizes, terms, starts = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words, hits = (text or "").encode().split(b" "), {}
                for start, word in enumerate(words):
                    at, h = start + 1, crc32(word)
                    while True:
                        bit = h & mask
                        if bits[bit >> 3] >> (bit & 7) & 1:
                            hits.setdefault((b" ".join(words[start:at]), at - start), []).append(start)
                        h = crc32(b" ", h)
                        bit = h & mask
                        if at == len(words) or not bits[bit >> 3] >> (bit & 7) & 1:
                            break
                        h, at = crc32(words[at], h), at + 1
                rows += [row] * len(hits)
                terms += (term.decode() for term, _ in hits)
                sizes += (n for _, n in hits)
                starts += hits.values()
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int32()), pa.array(terms, pa.string()), pa.array(starts, pa.list_(pa.int32()))],
                                             ["row", "n", "term", "starts"])
    return run


def _trie(terms: list[str]) -> tuple[dict, dict, set]:
    """Nodes by first word, nodes by (node, next word), and the nodes that end a term."""
    first: dict[str, int] = {}
    steps: dict[tuple[int, str], int] = {}
    ends = set()
    for term in terms:
        words = term.split(" ")
        node = first.setdefault(words[0], len(first) + len(steps))
        for word in words[1:]:
            node = steps.setdefault((node, word), len(first) + len(steps))
        ends.add(node)
    return first, steps, ends


def text_concepts(docs: DataFrame, key: str, text: str, terms: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, term, n_hits): how often each term of ``terms`` (column ``term``) stands in the texts of a key,
    not counting places inside a longer term.

    Terms are compared as words; a null or wordless term and a null text match nothing; rows of one key count together."""
    context = docs.sparkSession.sparkContext
    known = terms.select(words_text(F.col("term")).alias("term")).where(F.length("term") > 0).distinct()
    known = materialize(known)
    size = known.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    read = docs.select(F.col(key).alias("row"), words_text(F.col(text)).alias("text"))
    row_type = read.schema["row"].dataType.simpleString()
    if size <= block_bytes:
        trie = context.broadcast(_trie([r[0] for r in known.collect()]))
        hits = read.mapInArrow(_scan(trie), f"row {row_type}, term string, n_hits bigint")
        return hits.groupBy(F.col("row").alias(key), "term").agg(F.sum("n_hits").alias("n_hits"))
    n_bits = min(SIEVE_BITS, max(1 << 20, 1 << int(size).bit_length()))  # some 30 bits a term
    sieve = context.broadcast(_sieve(known, n_bits))
    read = read.withColumn("id", F.monotonically_increasing_id()).select(F.struct("id", "row").alias("row"), "text")
    row_type = read.schema["row"].dataType.simpleString()
    maybe = read.mapInArrow(_sifted(sieve, n_bits), f"row {row_type}, n int, term string, starts array<int>")
    hits = maybe.join(known, "term", "left_semi").select("row.id", "row.row", "n", "term", F.explode("starts").alias("start"))
    # in order of start, the longest first, an earlier match reaches as far as any that holds a later one
    end = F.col("start") + F.col("n")
    earlier = Window.partitionBy("id").orderBy("start", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    kept = hits.withColumn("reach", F.max(end).over(earlier)).where(F.col("reach").isNull() | (F.col("reach") < end))
    return kept.groupBy(F.col("row").alias(key), "term").agg(F.count(F.lit(1)).alias("n_hits"))
