"""Common prefixes, overlaps and repetition (SCL-33, SCL-66..74, AGG-28..30, AGG-44..49, MTH-07)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.text import normalize_zh

#: Fixed values.
WORD_HEADS = "一这那其某各该此每两几何"
NOISE_PREFIXES = ("一们", "一为", "一名", "一位", "们", "为", "名", "位")
MARKERS = ("而且", "并且", "同时", "此外", "然后", "另外", "而", "并")
LEADING = "^[，。、；：！？,.!?;:\\s]+"


def lcp_length(x: Column, y: Column) -> Column:
    """MTH-07: characters that two strings share at the start, in one pass over them."""
    n = F.least(F.length(x), F.length(y))
    bad = F.array_position(F.zip_with(F.split(F.left(x, n), ""), F.split(F.left(y, n), ""), lambda a, b: a == b), False)
    return F.when(n == 0, 0).when(bad > 0, bad - 1).otherwise(n).cast("int")


def lcp_chars(a: Column) -> Column:
    """SCL-66, AGG-46: longest common prefix of an array of strings; '' for none."""
    return F.when(F.size(a) == 0, "").otherwise(F.aggregate(a, F.get(a, 0), lambda x, y: F.left(x, lcp_length(x, y))))


def lcp_words(a: Column) -> Column:
    """SCL-67: words shared at the start, joined by spaces; a single hypothesis is returned as it stands."""

    def common(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        bad = F.get(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: ~F.get(x, k).eqNullSafe(F.get(y, k))), 0)
        return F.when(n == 0, F.slice(x, 1, 0)).otherwise(F.slice(x, F.lit(1), F.coalesce(bad, n)))

    lists = F.transform(a, lambda s: F.filter(F.split(s, "\\s+"), lambda t: t != ""))
    return F.when(F.size(a) == 0, "").when(F.size(a) == 1, F.get(a, 0)).otherwise(F.array_join(F.aggregate(lists, F.get(lists, 0), common), " "))


def strip_overlap(committed: Column, delta: Column) -> Column:
    """SCL-69: ``delta`` without the longest suffix of ``committed`` that it starts with."""
    n = F.least(F.length(committed), F.length(delta))
    k = F.get(F.filter(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.substr(committed, F.length(committed) - k + 1, k) == F.substr(delta, F.lit(1), k)), 0)
    return F.when(n == 0, delta).when(k.isNull(), delta).otherwise(F.regexp_replace(F.substr(delta, k + 1), "\\s", ""))


def repeated_pattern(c: Column) -> Column:
    """SCL-71: three to eight characters twice in a row."""
    return F.regexp_replace(c, "\\s", "").rlike("(?s)(.{3,8})\\1")


def ends_on_word_head(c: Column) -> Column:
    """SCL-72."""
    return c.rlike(f"[{WORD_HEADS}]$")


def semantic_key(c: Column, size: int = 5) -> Column:
    """SCL-73: without leading marks and one noise prefix, cut to ``size``."""
    d = F.regexp_replace(F.trim(c), "^[，。、；：！？\\s]+", "")
    return F.left(F.regexp_replace(d, "^(?:" + "|".join(NOISE_PREFIXES) + ")", ""), F.lit(size))


def strip_marker(c: Column) -> Column:
    """SCL-74: without leading marks and one discourse marker."""
    t = F.regexp_replace(F.regexp_replace(c, "\\s", ""), LEADING, "")
    cut = F.regexp_replace(t, "^(?:" + "|".join(MARKERS) + ")", "")
    return F.when(cut != t, F.regexp_replace(cut, LEADING, "")).otherwise(t)


def prefix_support(prefix: Column, fragments: Column) -> Column:
    """AGG-30: fragments that start with ``prefix``; none support ''."""
    return F.when(prefix == "", 0).otherwise(F.size(F.filter(fragments, lambda f: F.startswith(f, prefix))))


def quorum_prefix_of(seed: Column, fragments: Column, k: Column) -> Column:
    """AGG-44: the longest prefix of ``seed`` that ``k`` fragments share, or '': as long as the k-th longest prefix shared with any."""
    shared = F.sort_array(F.transform(fragments, lambda f: lcp_length(seed, f)), asc=False)
    return F.when(k <= 0, "").otherwise(F.left(seed, F.coalesce(F.get(shared, k - 1), F.lit(0))))


def quorum_prefix(fragments: Column, k: Column) -> Column:
    """AGG-28, AGG-45: the longest prefix that ``k`` fragments share; of equally long ones that of the earliest fragment."""
    best = F.transform(fragments, lambda f: quorum_prefix_of(f, fragments, k))
    return F.when(F.size(fragments) == 0, "").otherwise(F.aggregate(best, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a)))


def quorum(count: Column, ratio: float) -> Column:
    """MTH-11: max(1, ceil(ratio * count))."""
    return F.greatest(F.lit(1), F.ceil(F.lit(ratio) * count)).cast("int")


def deltas_after(committed: Column, prefixes: Column) -> Column:
    """AGG-49: what each prefix adds to ``committed``; '' where it doesn't extend it."""
    return F.transform(prefixes, lambda p: F.when(F.startswith(p, committed), F.substr(p, F.length(committed) + 1)).otherwise(""))


def direction(deltas: Column, size: int = 3) -> Column:
    """AGG-29: struct(top key, share) of the deltas' keys; ties go to the key seen first."""
    kept = F.filter(F.transform(deltas, F.trim), lambda d: d != "")
    keys = F.transform(kept, lambda d: F.when(semantic_key(d, size) != "", semantic_key(d, size)).otherwise(F.left(d, F.lit(size))))
    counted = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.size(F.filter(keys, lambda x: x == k)).alias("n")))
    start = F.struct(F.lit("").alias("key"), F.lit(0).alias("n"))
    top = F.aggregate(counted, start, lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a))
    return F.struct(top["key"].alias("key"), F.when(F.size(keys) == 0, 0.0).otherwise(top["n"] / F.greatest(F.size(keys), F.lit(1))).alias("share"))


def trim_repetition(text: str | None, least: int = 8, most: int = 60) -> str | None:
    """SCL-70, for use inside Arrow functions: a phrase repeated at the end is kept once."""
    if not text or len(text) < 2 * least:
        return text
    for p in range(least, min(most, len(text) // 2) + 1):
        while len(text) > 2 * p and text.endswith(text[-2 * p : -p]):
            text = text[:-p]
    return text


def strip_observed(observed: Column, continuation: Column, least: int = 3) -> Column:
    """SCL-33: a continuation without the longest prefix, of ``least`` characters or more, that the observed text ends with."""
    n = F.least(F.length(observed), F.length(continuation))
    k = F.get(F.filter(F.sequence(n, F.lit(least), F.lit(-1)), lambda k: F.lower(F.substr(observed, F.length(observed) - k + 1, k)) == F.lower(F.substr(continuation, F.lit(1), k))), 0)
    return F.when(n < least, continuation).when(k.isNull(), continuation).otherwise(F.ltrim(F.substr(continuation, k + 1)))


def quorum_backoff(output: Column, fragments: Column, k: Column) -> Column:
    """SCL-75: what ``k`` fragments support of a refused output: its longest supported prefix as it stands, else without
    leading markers on both sides, else the longest prefix that ``k`` of the fragments without markers share."""
    bare = F.filter(F.transform(fragments, strip_marker), lambda f: f != "")
    raw = quorum_prefix_of(output, fragments, k)
    cut = quorum_prefix_of(strip_marker(output), bare, k)
    return F.when(raw != "", raw).when(F.size(bare) < k, "").when(cut != "", cut).otherwise(quorum_prefix(bare, k))


def lcp_normalized(a: Column, b: Column) -> Column:
    """SCL-68: the common prefix of two texts without white space."""
    x, y = normalize_zh(a), normalize_zh(b)
    return F.left(x, lcp_length(x, y))


def shortest(prefixes: Column) -> Column:
    """AGG-34: the shortest of several safe prefixes, the first of equally short ones; null for none."""
    return F.get(prefixes, (F.array_position(F.transform(prefixes, F.length), F.array_min(F.transform(prefixes, F.length))) - 1).cast("int"))
