"""Quality classifier: document evidence and site posteriors by hierarchical empirical Bayes.

Two judgements, quality and toxicity, share the machinery. Document evidence is a
logistic regression over features whose presence differs significantly between the labelled
classes: exact words, and binned shape features of the whole text (share of symbols,
repeated words, distinct phrases, length). It is fitted on a bounded sample of at most
``max_labelled`` labelled documents (chosen by hash of the id, equal texts once); the
model has at most ``max_features`` features a judgement. Each judgement is fitted on the rows that
have it, whatever the other says. Its log odds less the sample's prior are the evidence.

Site posteriors: hosts and paths (a path is a host's section; here source and, within
it, language) have beta posteriors of their rate. A host's mean shrinks toward the global
mean, a path's toward its host's, with prior strengths estimated from the spread of hosts round the
global mean and of paths round their own host's (method of moments, over all sites). All sites' sums come from one grouped aggregation per level.
A document's own score is left out of its site's sum; then its evidence is combined with
the path's posterior in place of the global prior.

Scale: one pass over the texts; a site with a third of all documents is one row after
partial aggregation, and the site table is joined to thin (id, site, score) rows, not to
texts. Only the bounded model reaches the driver.

Defined results: a null text has no words and is judged by its shape and its site; very long texts are
read whole; null sites are sites of their own; a label without an id or without either judgement is not used;
of clashing labels of one id, and of equal texts, the greatest counts (1 before 0), for each judgement by itself; without labels of
both classes the evidence is 0 and the prior one half; repeated rows are judged each; an empty table gives
no rows; other columns are not read, so none can clash.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hash_sample, ship
from tidemark.session import materialize

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SYMBOLS = re.compile(rb"[#*$%&|<>]")
HEADS = ("quality", "toxic")


def _bin(value: float, edges) -> int:
    return sum(value >= e for e in edges)


def features(text: str | None) -> set[bytes]:
    """Distinct lower-cased words, and shape features (which start with a space)."""
    data = (text or "").encode().lower()
    words = WORD.findall(data)
    n = max(1, len(words))
    out = set(words)
    pairs = sum(1 for _ in filter(None, map(bytes.__eq__, words, words[1:])))
    grams = len(set(zip(words, words[1:], words[2:])))
    shape = {b"symbols": _bin(len(SYMBOLS.findall(data)) / n, (0.005, 0.05, 0.2, 0.8, 2)), b"stutter": _bin(pairs / n, (0.05, 0.2, 0.5)),
             b"phrases": _bin(grams / max(1, n - 2), (0.2, 0.5, 0.8, 0.95)), b"length": _bin(math.log2(n), (3, 5, 8))}
    return out | {b" %s=%d" % x for x in shape.items()}


def _exploded(batches):
    for b in batches:
        rows, names = [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            for f in features(text):
                rows.append(i)
                names.append(f)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(b.column(h).take(at) for h in HEADS)], ["feature", *HEADS])


def _present(vocabulary):
    known = {f: i for i, f in enumerate(vocabulary)}

    def run(batches):
        for b in batches:
            found = [[known[f] for f in features(t) if f in known] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *(b.column(h) for h in HEADS)], ["present", *HEADS])
    return run


def logistic(present: list[list[int]], y: np.ndarray, n_features: int, l2: float = 0.1, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L2-regularised logistic regression on 0/1 features (full-batch Adam)."""
    row = np.repeat(np.arange(len(y)), [len(x) for x in present])
    col = np.array([i for x in present for i in x], np.int64)
    w = np.zeros(n_features + 1)
    w[-1] = math.log(y.sum() / (len(y) - y.sum()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.clip(np.bincount(row, w[col], len(y)) + w[-1], -30, 30)
        miss = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(col, miss[row], n_features) + l2 * w[:-1], miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.2 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return float(w[-1]), w[:-1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 10_000,
        max_features: int = 1024, least_df: int = 4, least_z: float = 5.0) -> dict[str, tuple[float, float, dict[bytes, float]]]:
    """Per judgement: (prior log odds, intercept, weight per feature); both 0 and no weights without both classes."""
    ship(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("id"), *(F.col(h).cast("int").alias(h) for h in HEADS)).dropna(subset=["id"]).dropna("all", subset=list(HEADS))
    chosen = materialize(hash_sample(materialize(chosen.groupBy("id").agg(*(F.max(h).alias(h) for h in HEADS))), max_labelled, "id"))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # max_labelled rows
    sample = materialize(sample.groupBy("text").agg(*(F.max(h).alias(h) for h in HEADS)))
    sizes = sample.agg(*(F.sum((F.col(h) == v).cast("int")).alias(f"{h}{v}") for h in HEADS for v in (0, 1))).first()
    schema = T.StructType([T.StructField("feature", T.BinaryType()), *(T.StructField(h, T.IntegerType()) for h in HEADS)])
    counts = sample.mapInArrow(_exploded, schema).groupBy("feature").agg(
        F.count(F.lit(1)).alias("df"), *(F.coalesce(F.sum((F.col(h) == v).cast("int")), F.lit(0)).alias(f"{h}{v}") for h in HEADS for v in (0, 1)))
    counts = materialize(counts.where(F.col("df") >= least_df))
    usable = [h for h in HEADS if sizes[f"{h}0"] and sizes[f"{h}1"]]
    vocabulary: list[bytes] = []
    of: dict[str, set[bytes]] = {}
    for h in usable:
        n0, n1 = sizes[f"{h}0"], sizes[f"{h}1"]
        p0, p1, both = F.col(f"{h}0") / F.lit(n0), F.col(f"{h}1") / F.lit(n1), (F.col(f"{h}0") + F.col(f"{h}1")) / F.lit(n0 + n1)
        z = F.abs(p1 - p0) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * F.lit(1 / n0 + 1 / n1))
        rows = counts.select("feature", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(max_features).collect()
        of[h] = {bytes(r["feature"]) for r in rows}
        vocabulary += sorted(of[h].difference(vocabulary))
    schema = T.StructType([T.StructField("present", T.ArrayType(T.IntegerType())), *schema.fields[1:]])
    rows = sample.mapInArrow(_present(vocabulary), schema).collect() if usable else []  # at most max_labelled
    model = {h: (0.0, 0.0, {}) for h in HEADS}
    for h in usable:
        own = [r for r in rows if r[h] is not None]
        y = np.array([r[h] for r in own], float)
        mine = [i for i, f in enumerate(vocabulary) if f in of[h]]
        at = {i: k for k, i in enumerate(mine)}
        bias, w = logistic([[at[i] for i in r["present"] if i in at] for r in own], y, len(mine))
        model[h] = (math.log(y.sum() / (len(y) - y.sum())), bias, {vocabulary[i]: float(x) for i, x in zip(mine, w)})
    return model


def evidence(present: set[bytes], head: tuple[float, float, dict[bytes, float]]) -> float:
    """Log odds of the document less the sample's prior."""
    prior, bias, weights = head
    return bias - prior + sum(weights[f] for f in present if f in weights)


def _scored(model):
    def run(batches):
        for b in batches:
            found = [features(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([max(-30.0, min(30.0, evidence(f, model.value[h]))) for f in found], pa.float64()) for h in HEADS]
            keep = ["id", "host", "path"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *HEADS])
    return run


def _strength(sites: DataFrame, size: str, total: str, group_size: str, group_total: str) -> float:
    """Method of moments: prior strength of a beta from the weighted spread of the sites' rates round their groups'."""
    n, group = F.col(size), F.col(group_size)
    rate, centre = F.col(total) / n, F.col(group_total) / group
    row = sites.where(n > 0).agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(n / group).alias("groups"),
                                 F.sum(n * (rate - centre) ** 2).alias("ss"), F.sum(n * n / group).alias("n2"),
                                 F.sum(n * centre * (1 - centre)).alias("noise")).first()
    if not row["n"] or row["k"] - row["groups"] < 0.5 or row["noise"] <= 0:
        return 100.0
    noise = row["noise"] / row["n"]
    between = (row["ss"] - (row["k"] - row["groups"]) * noise) / max(1e-9, row["n"] - row["n2"])
    return min(1e4, max(5.0, noise / between - 1)) if between > 0 else 1e4


def combine(scored: DataFrame, model) -> DataFrame:
    """``scored`` with the log odds of each head given the document and its site: ``{head}_odds``; and ``{head}_site``."""
    for h in HEADS:
        prior = model[h][0]
        scored = scored.withColumn(f"{h}_p", 1 / (1 + F.exp(-(F.col(h) + F.lit(prior)))))
    sums = [x for h in HEADS for x in (F.sum(f"{h}_p").alias(f"{h}_s"),)]
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums))
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("host_n"), *(F.sum(f"{h}_s").alias(f"{h}_host_s") for h in HEADS)))
    total = hosts.agg(F.sum("host_n").alias("n"), *(F.sum(f"{h}_host_s").alias(h) for h in HEADS)).first()
    sites = materialize(paths.withColumnRenamed("host", "p_host").withColumnRenamed("path", "p_path").alias("p").join(
        hosts.withColumnRenamed("host", "h_host").alias("h"), F.col("p_host").eqNullSafe(F.col("h_host"))).drop("h_host"))
    out = scored.join(sites, scored["host"].eqNullSafe(sites["p_host"]) & scored["path"].eqNullSafe(sites["p_path"]))
    for h in HEADS:
        mean = min(1 - 1e-6, max(1e-6, (total[h] or 0.0) / (total["n"] or 1.0)))
        k_host = _strength(hosts.withColumns({"all_n": F.lit(total["n"]), "all_s": F.lit(total[h])}), "host_n", f"{h}_host_s", "all_n", "all_s")
        k_path = _strength(sites, "n", f"{h}_s", "host_n", f"{h}_host_s")
        # the document's own score is left out of both sums
        host = (F.col(f"{h}_host_s") - F.col(f"{h}_p") + k_host * mean) / (F.col("host_n") - 1 + k_host)
        path = (F.col(f"{h}_s") - F.col(f"{h}_p") + k_path * host) / (F.col("n") - 1 + k_path)
        path = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), path))
        out = out.withColumn(f"{h}_site", path).withColumn(f"{h}_odds", F.col(h) + F.log(path / (1 - path)))
    return out


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
             path_col: str = "lang", least_quality: float = 0.5, most_toxic: float = 0.5, **fitting) -> DataFrame:
    """(doc_id, quality_evidence, quality_site, quality, toxic_evidence, toxic_site, toxic, is_toxic, kept) for every row.
    ``quality`` and ``toxic`` are probabilities given the document and its site."""
    spark = docs.sparkSession
    ship(spark)
    model = fit(docs, labels, id_col, text_col, **fitting)
    held = spark.sparkContext.broadcast(model)  # at most max_features weights a head
    thin = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"),
                       F.col(text_col).alias("text"))
    schema = T.StructType([*thin.schema.fields[:3], *(T.StructField(h, T.DoubleType()) for h in HEADS)])
    scored = materialize(thin.mapInArrow(_scored(held), schema))
    both = combine(scored, model)
    p = {h: 1 / (1 + F.exp(-F.col(f"{h}_odds"))) for h in HEADS}
    return both.select(F.col("id").alias("doc_id"), *(c for h in HEADS for c in (
        F.col(h).alias(f"{h}_evidence"), F.col(f"{h}_site"), p[h].alias(h))), (p["toxic"] > most_toxic).alias("is_toxic"),
        ((p["quality"] >= least_quality) & (p["toxic"] <= most_toxic)).alias("kept"))
