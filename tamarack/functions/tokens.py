"""Token rules of consensus decoding, over a vocabulary's texts (FLT-16..20, FLT-35, SCL-77)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import blank, suspicious

#: Fixed values.
SPECIAL_TEXTS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>")


def refusal(token: Column, text: Column, special: Column | None = None, broken_too: bool = False) -> Column:
    """FLT-16: why a token may not be generated, null if it may; FLT-17 with ``broken_too``: replacement characters as well.

    ``special`` tells whether the id is one of the tokenizer's special ones. A null id is missing; a null text counts as empty.
    """
    t = blank(text)
    named = F.lit(False)
    for s in SPECIAL_TEXTS:
        named = named | F.contains(t, F.lit(s))
    rule = F.when(token.isNull(), "missing_token_id")
    if special is not None:
        rule = rule.when(special, "special_token_id")
    rule = rule.when(named, "special_token_text").when(t.rlike("[A-Za-z]"), "ascii_letters")
    if broken_too:
        rule = rule.when(t.rlike("\\uFFFD"), "replacement_char")
    return rule.when(t.rlike("[\\u200d\\ufe0f]"), "zero_width_or_variation_selector").when(t.rlike("[\\p{Cc}\\p{Cs}]"), "control_or_surrogate")


def allowed_candidates(dist: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """FLT-18, JOI-31: the rows of ``dist`` whose token the vocabulary (token, text, special) doesn't refuse; unknown tokens go too."""
    fit = vocabulary.filter(refusal(F.col(token), F.col("text"), F.col("special")).isNull()).select(token)
    return dist.join(fit, token, "left_semi").select(*dist.columns)


def split_pending(texts: Column, ids: Column) -> Column:
    """FLT-35: struct(kept, removed): pending ids without those refused, which are logged as (position, token_id, reason)."""
    rows = F.zip_with(F.transform(ids, lambda t, i: F.struct(i.alias("position"), t.alias("token_id"))), texts, lambda r, t: F.struct(r["position"].alias("position"), r["token_id"].alias("token_id"), refusal(r["token_id"], t).alias("reason")))
    return F.struct(F.transform(F.filter(rows, lambda r: r["reason"].isNull()), lambda r: r["token_id"]).alias("kept"), F.filter(rows, lambda r: r["reason"].isNotNull()).alias("removed"))


def clean_prefix_length(decoded: Column) -> Column:
    """SCL-77: how many pending tokens may be committed, from the decoded texts of their prefixes: up to the last prefix that ends cleanly."""
    return F.coalesce(F.array_max(F.transform(decoded, lambda t, i: F.when(~suspicious(t), i + 1))), F.lit(0))


def above_horizon(pending: Column, least: int) -> Column:
    """FLT-19: the pending tokens, or none if there are some but fewer than ``least``."""
    return F.when((F.size(pending) > 0) & (F.size(pending) < least), F.slice(pending, 1, 0)).otherwise(pending)


def must_read(observed: Column, futures: Column, least_words: int, least_futures: int) -> Column:
    """FLT-20: too few words heard, or too few futures sampled."""
    return (F.size(F.filter(F.split(blank(observed), "\\s+"), lambda w: w != "")) < least_words) | (F.size(futures) < least_futures)
