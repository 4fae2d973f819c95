"""Quality scores: filters, joins, comparison of score sets (FLT-01..04, FLT-34, JOI-05, JOI-06, JOI-10..13, AGG-05, AGG-06, AGG-21..23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passes(score: Column, threshold: float, keep_nan: bool = False) -> Column:
    """FLT-01 (``keep_nan``), FLT-02: lower is better; a missing score never passes."""
    low = score <= threshold
    return F.coalesce((low & ~F.isnan(score)) | (F.isnan(score) & F.lit(keep_nan)), F.lit(False))


def every_sentence_passes(df: DataFrame, doc: str, score: str, threshold: float) -> DataFrame:
    """FLT-03: documents all of whose sentences pass, with their worst score."""
    return df.groupBy(doc).agg(F.max(score).alias("worst"), F.bool_and(passes(F.col(score), threshold)).alias("ok")).filter("ok").select(doc, "worst")


def in_band(ratio: Column, low: float = 0.7, high: float = 1.5) -> Column:
    """FLT-04: NaN and null are out."""
    return F.coalesce(ratio.between(low, high) & ~F.isnan(ratio), F.lit(False))


def final_table(scores: DataFrame, stream: DataFrame, keys: list[str], threshold: float, levels: tuple[str, ...] | None = None, level: str = "latency") -> DataFrame:
    """JOI-05, JOI-06, FLT-08: stream rows whose score passes, levels of the domain only. Scores are filtered before the join."""
    kept = scores.filter(passes(F.col("prediction"), threshold))
    if levels:
        kept = kept.filter(F.col(level).isin(*levels))
    return stream.join(kept, keys)


def summary(df: DataFrame, score: str, *by: str) -> DataFrame:
    """AGG-05: n, mean and linear 10, 25, 50, 75 and 90 % points."""
    cuts = (0.1, 0.25, 0.5, 0.75, 0.9)
    p = F.percentile(score, F.array(*[F.lit(c) for c in cuts]))
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), p.alias("p")).select(*by, "n", "mean", *[F.get("p", k).alias(f"p{round(c * 100)}") for k, c in enumerate(cuts)])


def share_below(score: Column, threshold: float) -> Column:
    """AGG-06."""
    return F.avg((score < threshold).cast("int"))


def latest_score(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """JOI-11, JOI-12: of equal keys the last row's score."""
    return df.groupBy(*keys).agg(F.max_by(score, order).alias(score))


def compare(a: DataFrame, b: DataFrame, keys: list[str], score: str) -> DataFrame:
    """JOI-10, JOI-11, JOI-13: one row: common and one-sided keys, both means, wins of either (lower is better)."""
    both = a.select(*keys, F.col(score).alias("a")).join(b.select(*keys, F.col(score).alias("b")), keys, "full_outer")
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(
        F.count_if(common).alias("common"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"),
        F.avg(F.when(common, F.col("a"))).alias("mean_a"), F.avg(F.when(common, F.col("b"))).alias("mean_b"),
        F.count_if(common & (F.col("a") < F.col("b"))).alias("a_better"), F.count_if(common & (F.col("b") < F.col("a"))).alias("b_better"),
    )


def hit_rate(hits: Column, queries: Column) -> Column:
    """AGG-22: per cent from two growing counters over a group; NaN if no query was made."""
    dq = F.max(queries) - F.min(queries)
    return F.when(dq > 0, 100.0 * (F.max(hits) - F.min(hits)) / F.when(dq != 0, dq)).otherwise(F.lit(float("nan")))


def timings(df: DataFrame, seconds: str, calls: str, *by: str) -> DataFrame:
    """AGG-21: rows, seconds and calls in all, seconds a row and a call (null without calls)."""
    g = df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(seconds).alias("seconds"), F.sum(calls).alias("calls"))
    return g.withColumns({"per_row": F.col("seconds") / F.col("rows"), "per_call": F.try_divide("seconds", "calls")})


def token_cost(prompt: Column, answer: Column, prompt_price: float, answer_price: float) -> Column:
    """AGG-23: the price of summed tokens, prices by the million."""
    return (F.sum(prompt) * prompt_price + F.sum(answer) * answer_price) / 1_000_000
