"""Scoring expressions over answer columns (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import extract_answer, nonblank_lines


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def lower_set(arr: Column | str) -> Column:
    return F.array_distinct(F.transform(_c(arr), lambda s: F.lower(s)))


def set_prf(labels: Column | str, preds: Column | str) -> Column:
    """G1: precision/recall/F1 of lower-cased sets; 0 when a side is empty."""
    t, p = lower_set(labels), lower_set(preds)
    inter = F.size(F.array_intersect(t, p)).cast("double")
    prec = F.when(F.size(p) > 0, inter / F.size(p)).otherwise(F.lit(0.0))
    rec = F.when(F.size(t) > 0, inter / F.size(t)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return F.struct(prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def prefix_acc(label: Column | str, pred: Column | str) -> Column:
    """1.0 when the prediction starts with the label (case-sensitive text)."""
    return F.when(_c(pred).startswith(_c(label)), F.lit(1.0)).otherwise(F.lit(0.0))


def contains_acc(category: Column | str, pred: Column | str) -> Column:
    """Lower-cased containment."""
    return F.when(F.lower(_c(pred)).contains(F.lower(_c(category))), F.lit(1.0)).otherwise(F.lit(0.0))


def choice_correct(pred_text: Column | str, answer: Column | str, answer_idx: Column | str) -> Column:
    """Answer text contained, 'idx.' contained, or the single letter equals idx."""
    p = extract_answer(pred_text)
    a, i = _c(answer), _c(answer_idx)
    return (F.lower(p).contains(F.lower(a)) | p.contains(F.concat(i, F.lit(".")))
            | ((F.length(p) == 1) & (p == i)))


def entity_correct(pred_text: Column | str, answer: Column | str) -> Column:
    """Answer contained in the to-end extraction."""
    p = extract_answer(pred_text, to_end=True)
    return F.lower(p).contains(F.lower(_c(answer)))


def pass_at_k(n: Column | str, c: Column | str, k: Column | str) -> Column:
    """1 - prod_{i=n-c+1..n} (1 - k/i); 1.0 when n - c < k."""
    n_, c_, k_ = _c(n), _c(c), _c(k)
    prod = F.aggregate(
        F.sequence(n_ - c_ + 1, n_),
        F.lit(1.0),
        lambda acc, i: acc * (F.lit(1.0) - k_.cast("double") / i),
    )
    return F.when(n_ - c_ < k_, F.lit(1.0)).when(c_ == 0, F.lit(0.0)).otherwise(F.lit(1.0) - prod)


def reward_verify(completion: Column | str, labels: Column | str, metric: Column | str) -> Column:
    """0 without '</think>'; else F1 (set metrics) or prefix accuracy of the tail."""
    comp = _c(completion)
    tail = F.substring_index(comp, "</think>", -1)
    f1 = set_prf(labels, nonblank_lines(tail))["f1"]
    acc = prefix_acc(F.try_element_at(_c(labels), F.lit(1)), tail)
    m = _c(metric)
    return (F.when(~comp.contains("</think>"), F.lit(0.0))
            .when(m.isin("em", "f1", "recall", "precision"), f1)
            .when(m.isin("acc", "aucroc"), acc))


# Section headings the format reward requires.
FORMAT_HEADINGS = ("## Extraction", "## Reasoning", "## Final Results")


def reward_format(completion: Column | str) -> Column:
    """-1 unless both think tags, the three headings in the reasoning and no
    repeated answer lines; otherwise 1."""
    comp = _c(completion)
    tail = F.substring_index(comp, "</think>", -1)
    reasoning = F.left(comp, F.greatest(F.lit(0), F.length(comp) - F.length(tail) - F.lit(len("</think>"))))
    answer_lines = nonblank_lines(tail)
    headings_ok = F.lit(True)
    for h in FORMAT_HEADINGS:
        headings_ok = headings_ok & reasoning.contains(h)
    tags_ok = comp.contains("</think>") & comp.contains("<think>")
    unique_ok = F.size(F.array_distinct(answer_lines)) == F.size(answer_lines)
    return F.when(tags_ok & headings_ok & unique_ok, F.lit(1)).otherwise(F.lit(-1))
