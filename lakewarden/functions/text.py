"""Text measures as Columns: token estimates, sentences, features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of words, CJK characters and sentences
WORD = r"[A-Za-z_][A-Za-z0-9_]*|\d+"
CJK = r"[一-鿿]"
SENTENCE = r"[^。！？；!?;]+[。！？；!?;]?"


def token_estimate(text: Column) -> Column:
    """CJK characters, plus 1.3 tokens a word, plus one."""
    text = F.coalesce(text, F.lit(""))
    return (F.regexp_count(text, F.lit(CJK)) + F.floor(F.regexp_count(text, F.lit(WORD)) * F.lit(1.3)) + 1).cast("long")


def sentences(line: Column) -> Column:
    """Trimmed, non-empty sentences of one line; a full stop does not end one."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(SENTENCE), F.lit(0)), F.trim), lambda s: s != "")


def word_features(text: Column) -> Column:
    """Lower-cased words, one entry each occurrence (weight 1)."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


def cjk_features(text: Column) -> Column:
    """Bigrams of runs of CJK characters; a run of one stands for itself."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{CJK}+"), F.lit(0))
    grams = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.flatten(grams)
