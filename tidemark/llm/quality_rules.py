"""Quality rules: counts per text, thresholds from mergeable quantile sketches, joined filtering.

Native: DataFrame and SQL functions only.

The sketch of a measure is a histogram of its whole-number value in log-linear buckets
(32 to the octave, so a quantile is within 1/32 of the exact one): rows (lang, source,
measure, bucket, count). Merging is adding counts, so the sketch of a language or of the
corpus is the merge of its sources' sketches, partial aggregation does the work before the
shuffle, a source with a third of all rows costs one row per bucket, and the result does
not depend on order or partitioning.

Thresholds replace fixed cutoffs: per (language, source) a measure may exceed its median
by ``spread`` times the distance from the median to the upper quartile, and never counts
as odd within ``slack`` of the median. A group with fewer than ``min_rows`` texts, or whose own
upper quartile is above the language's limit (a source that is mostly junk must not set
its own standard), takes the language's threshold, a small language the corpus's.

Defined results: a null text has no words and counts of 0; null languages and sources are
groups of their own; repeated rows count once each; texts are taken whole at any length; an empty table gives no rows; other
columns are carried unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_SPACE, broadcast_up_to, let
from tidemark.session import materialize

WINDOW = 8
#: Measures: whole thousandths, and the slack about the median within which nothing is odd.
MEASURES = {"symbols": 50, "dup_lines": 400, "word_length": 3000, "repeats": 250}
#: Measures of which low values are odd too.
TWO_SIDED = ("word_length",)


def words_of(text: Column) -> Column:
    """The maximal runs without space, tab, newline, vertical tab, form feed and carriage return."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{WORD_SPACE}]+|[{WORD_SPACE}]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WORD_SPACE}]+"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words that occur twice or more in ``words``."""
    def hashed(hs, step):
        n = F.size(hs) - step
        return F.when(n > 0, F.transform(F.slice(hs, 1, F.greatest(n, F.lit(0))),
                                         lambda h, i: F.xxhash64(h, F.get(hs, i + step)))).otherwise(F.array().cast("array<bigint>"))

    def covered(at):  # ascending first positions of repeated windows
        return F.aggregate(
            at, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def twice(ws):
        ordered = F.array_sort(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = let(ordered, lambda s: F.filter(
            F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])),
            lambda i: i.isNotNull()))
        return covered(F.array_sort(at))

    def doubled(step):
        return lambda hs: hashed(hs, step)

    steps = F.transform(words, lambda w: F.xxhash64(w))
    for k in range(window.bit_length() - 1):  # 1 -> 2 -> 4 -> 8 words to a hash
        steps = let(steps, doubled(1 << k))
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    return let(steps, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(twice(ws)))


def counts(text: Column) -> Column:
    """Struct of the whole text's counts."""
    has_word = f"[^{WORD_SPACE}]"
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(has_word))
    n_symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", ""))
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        n_symbols.cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words")))


def base_failed(c: str = "c") -> Column:
    return (F.col(f"{c}.n_words") < 20) | (100 * F.col(f"{c}.n_repeat_words") > 30 * F.col(f"{c}.n_words"))


def measures(c: str = "c") -> dict[str, Column]:
    """Whole thousandths of a word, line or character."""
    def per(x, n):
        return F.floor(F.col(f"{c}.{x}") * 1000 / F.greatest(F.col(f"{c}.{n}"), F.lit(1))).cast("long")
    return {"symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
            "word_length": per("word_chars", "n_words"), "repeats": per("n_repeat_words", "n_words")}


def bucket(value: Column) -> Column:
    """The lower bound of a value's log-linear bucket: its 6 leading bits."""
    return let(F.struct(value.alias("v"), F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long").alias("unit")),
               lambda x: x["v"] - x["v"] % x["unit"])


def sketches(df: DataFrame, by: list[str], c: str = "c") -> DataFrame:
    """The mergeable sketch: rows (by..., measure, bucket, n)."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), bucket(v).alias("bucket")) for m, v in measures(c).items()))
    return (df.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.measure", "p.bucket").agg(F.count(F.lit(1)).alias("n")))


def quantiles(sketch: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """Quantiles (whole-number bucket bounds) of each group's merged sketch, and the group's ``rows``."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")  # buckets of one measure: a few hundred rows at most
    ranked = merged.withColumn("up_to", F.sum("n").over(group.orderBy("bucket"))).withColumn("rows", F.sum("n").over(group))
    return ranked.groupBy(*by, "measure").agg(
        F.first("rows").alias("rows"),
        *(F.min(F.when(F.col("up_to") >= F.col("rows") * F.lit(q), F.col("bucket"))).alias(name) for name, q in at.items()))


def thresholds(sketch: DataFrame, spread: float = 6.0, min_rows: int = 50) -> DataFrame:
    """(lang, source, measure, low, high): values outside low..high are odd."""
    at = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    slack = F.create_map(*(x for m, s in MEASURES.items() for x in (F.lit(m), F.lit(s))))[F.col("measure")]

    def bounded(by, suffix):
        q = quantiles(sketch, by, at)
        high = F.col("q50") + F.greatest(slack.cast("double"), (F.col("q75") - F.col("q50")) * spread)
        low = F.when(F.col("measure").isin(*TWO_SIDED), F.col("q50") - F.greatest(slack.cast("double"), (F.col("q50") - F.col("q25")) * spread)) \
            .otherwise(F.lit(-1.0))
        return q.select(*by, "measure", F.col("rows").alias(f"rows{suffix}"), F.col("q75").alias(f"q75{suffix}"),
                        low.alias(f"low{suffix}"), high.alias(f"high{suffix}"))

    own, lang, every = bounded(["lang", "source"], ""), bounded(["lang"], "_l"), bounded([], "_c")
    lang = lang.withColumnRenamed("lang", "of_lang").withColumnRenamed("measure", "of_measure")
    every = every.withColumnRenamed("measure", "for_measure")
    j = own.join(lang, own["lang"].eqNullSafe(lang["of_lang"]) & (own["measure"] == lang["of_measure"])) \
        .join(every, own["measure"] == every["for_measure"])
    use_lang = F.col("rows_l") >= min_rows
    low_l, high_l = (F.when(use_lang, F.col(f"{x}_l")).otherwise(F.col(f"{x}_c")) for x in ("low", "high"))
    use_own = (F.col("rows") >= min_rows) & (F.col("q75") <= high_l)
    return j.select("lang", "source", "measure", F.when(use_own, F.col("low")).otherwise(low_l).alias("low"),
                    F.when(use_own, F.col("high")).otherwise(high_l).alias("high"))


def _limits(counted: DataFrame, spread: float, min_rows: int) -> DataFrame:
    """One row per (lang, source): a low and a high column per measure."""
    sketch = materialize(sketches(counted, ["lang", "source"]))
    t = thresholds(sketch, spread, min_rows)
    return materialize(t.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(
        *(F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{m}_{x}") for m in MEASURES for x in ("low", "high"))))


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` (columns lang, source, c) with base_failed and kept."""
    fits = F.lit(True)
    for m, v in measures().items():
        fits = fits & (v >= F.col(f"{m}_low")) & (v <= F.col(f"{m}_high"))
    limits = broadcast_up_to(limits, 100_000)  # one narrow row a group
    j = counted.join(limits, counted["lang"].eqNullSafe(limits["t_lang"]) & counted["source"].eqNullSafe(limits["t_source"]))
    # one condition of both sides: a filter on it stays above the join and is not evaluated on the counts again
    return j.withColumn("base_failed", base_failed()).withColumn("kept", F.when(base_failed(), F.lit(False)).otherwise(fits))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", spread: float = 6.0, min_rows: int = 50) -> DataFrame:
    """(id, c, base_failed, kept) for every row; ``c`` is the struct of counts. The texts are read once."""
    counted = materialize(docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                                      counts(F.col(text_col)).alias("c")))
    return judged(counted, _limits(counted, spread, min_rows)).select("id", "c", "base_failed", "kept")


def keep_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                 spread: float = 6.0, min_rows: int = 50) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. No text is shuffled: the rows are
    written once with their counts beside them, for the sketches and for the filter."""
    counted = materialize(docs.select(F.struct("*").alias("doc"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                                      counts(F.col(text_col)).alias("c")))
    return judged(counted, _limits(counted, spread, min_rows)).where("kept").select("doc.*")
