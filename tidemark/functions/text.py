"""Text expressions: value cleaning, answer parsing, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "missing" in stringified records.
MISSING_TEXTS = ("NaN", "nan", "None")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_value(x: Column | str, empty_as_null: bool = False) -> Column:
    """Number -> text; 'nan'/'NaN'/'None'/NULL -> '' (or NULL)."""
    s = _c(x).cast("string")
    known = F.when(~s.isin(*MISSING_TEXTS), s)
    return known if empty_as_null else F.coalesce(known, F.lit(""))


def truncate_left(text: Column | str, n: int) -> Column:
    """Keep the last ``n`` whitespace tokens (whole text when shorter)."""
    toks = F.split(_c(text), " ")
    size = F.size(toks)
    return F.when(size <= n, _c(text)).otherwise(
        F.array_join(F.slice(toks, F.greatest(F.lit(1), size - F.lit(n) + 1), F.lit(n)), " "))


def split_prediction(text: Column | str) -> Column:
    """Split on the two-character text '\\n' if present, else on newlines; trim."""
    t = _c(text)
    parts = F.when(t.contains("\\n"), F.split(t, r"\\\\n")).otherwise(F.split(t, "\n"))
    return F.transform(parts, lambda p: F.trim(p))


def nonblank_lines(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(text), "\n"), lambda p: F.trim(p)), lambda p: p != "")


def _strip_answer(x: Column) -> Column:
    return F.btrim(x, F.lit(" \n*{"))


ANSWER_TO_PERIOD = r"(?s)^.*[T|t]he answer is (.*?)(\.|$)"
ANSWER_TO_END = r"(?s)^.*[T|t]he answer is (.*)$"


def has_answer(text: Column | str) -> Column:
    """G9."""
    return _c(text).rlike(r"(?s)[T|t]he answer is ")


def extract_answer(text: Column | str, to_end: bool = False) -> Column:
    """Text after the last 'the answer is' up to a period (or the end);
    otherwise the last 100 characters. Stripped of ' \\n*{' on both sides."""
    t = _c(text)
    pat = ANSWER_TO_END if to_end else ANSWER_TO_PERIOD
    tail = F.when(F.length(t) > 100, F.substring(t, -100, 100)).otherwise(t)
    return F.when(has_answer(t), _strip_answer(F.regexp_extract(t, pat, 1))).otherwise(tail)


def split_thinking(text: Column | str) -> Column:
    """struct(reasoning, answer). '</think>' split (exactly one tag), or the
    channel-tagged final/analysis form; text left whole when neither parses."""
    t = _c(text)
    n_close = F.size(F.split(t, "</think>")) - 1
    think_reason = F.concat(F.substring_index(t, "</think>", 1), F.lit("</think>"))
    ws = F.lit(" \t\n\r")
    think_answer = F.btrim(F.substring_index(t, "</think>", -1), ws)
    final_pat = r"(?s)<\|channel\|>final<\|message\|>(.*?)<\|return\|>"
    anal_pat = r"(?s)<\|channel\|>analysis<\|message\|>(.*?)<\|end\|>"
    has_chan = t.rlike(final_pat) & t.rlike(anal_pat)
    answer = (F.when(n_close == 1, think_answer)
              .when(has_chan, F.btrim(F.regexp_extract(t, final_pat, 1), ws))
              .otherwise(t))
    reasoning = (F.when(n_close == 1, think_reason)
                 .when(has_chan, F.regexp_extract(t, anal_pat, 1)))
    return F.struct(reasoning.alias("reasoning"), answer.alias("answer"))
