"""Latency and quality metrics (MTH-01, MTH-02, MTH-06, MTH-08, MTH-10). What is undefined is NaN, never null."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.text import blank, strip, tokens

NAN = float("nan")


def laal(source: Column, deltas: Column, actions: Column, reference: Column) -> Column:
    """MTH-01: length-adaptive average lagging in source words; each written character is one emission.

    Characters that are never written count as emitted after the whole source. White space inside a delta is an
    emission; in the reference only U+0020 is left out.
    """
    rows = F.zip_with(F.zip_with(source, deltas, lambda s, d: F.struct(s.alias("s"), d.alias("d"))), actions, lambda r, a: F.struct(r["s"].alias("s"), r["d"].alias("d"), a.alias("a")))
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("t"))

    def step(acc: Column, r: Column) -> Column:
        x = acc["x"] + F.size(tokens(r["s"]))
        n = F.when(r["a"] == "WRITE", F.length(strip(blank(r["d"])))).otherwise(0)
        return F.struct(x.alias("x"), (acc["k"] + n).alias("k"), (acc["t"] + n * x).alias("t"))

    y = F.length(F.array_join(F.filter(deltas, lambda d: d.isNotNull()), ""))
    ref = F.length(F.replace(blank(reference), F.lit(" "), F.lit("")))
    n = F.greatest(y, ref)

    def lag(r: Column) -> Column:
        # The k emissions never outnumber n, so what is left of the n counts as the whole source.
        total = r["t"] + (n - r["k"]) * r["x"] - r["x"] * (n - 1) / 2
        return F.when((y == 0) | (r["x"] == 0) | (ref == 0) | (r["k"] == 0), F.lit(NAN)).otherwise(total / F.when(n != 0, n))

    return F.aggregate(rows, zero, step, lag)


def char_bleu_score(hypothesis: str | None, reference: str | None, order: int = 4, smooth: bool = True) -> float:
    """Character BLEU of one pair, for Arrow functions and tests."""
    h, r = "".join((hypothesis or "").split()), "".join((reference or "").split())
    most = min(order, len(h), len(r))
    if not most:
        return NAN
    logs = 0.0
    for n in range(1, most + 1):
        ours, theirs = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (h, r))
        hits, total = (ours & theirs).total(), ours.total()
        if not smooth and not hits:
            return 0.0
        logs += math.log((hits + smooth) / (total + smooth))
    brevity = 1.0 if len(h) > len(r) else math.exp(1 - len(r) / len(h))
    return 100 * brevity * math.exp(logs / most)


def char_bleu(hypothesis: Column, reference: Column, order: int = 4, smooth: bool = True) -> Column:
    """MTH-02, as an Arrow function: up to order-4 clipped precisions, add-one smoothed, with a brevity penalty."""

    @F.pandas_udf("double")
    def score(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([char_bleu_score(a, b, order, smooth) for a, b in zip(h, r, strict=True)], dtype="float64")

    return score(hypothesis, reference)


def expected_windows(seconds: Column, length: float = 1.0, eps: float = 1e-6) -> Column:
    """MTH-06: ceil(seconds / length - eps)."""
    return F.ceil(seconds / F.lit(length) - F.lit(eps)).cast("int")


def clip_count(frames: Column, multiplier: Column, clip: int = 15360) -> Column:
    """MTH-10: clips of ``multiplier`` steps of 960 ms at 16 kHz."""
    return F.ceil(frames / (F.lit(clip) * multiplier)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """MTH-08, in doubles."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
