"""Sinks (SNK-*): partitioned JSON and Parquet, review CSV, reports, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.parsing import recording_of, utt_language, utt_partition


def write_final(df: DataFrame, path: str, by: str = "recording", append: bool = False) -> None:
    """SNK-01, SNK-02: JSONL partitioned by recording (or language and partition) and latency; without ``append`` only partitions that come up are replaced."""
    cols = {"recording_id": recording_of(F.col("utt_id"))} if by == "recording" else {"lang": utt_language(F.col("utt_id")), "pq": utt_partition(F.col("utt_id"))}
    w = df.withColumns(cols).write.partitionBy(*cols, "latency")
    (w.mode("append") if append else w.mode("overwrite").option("partitionOverwriteMode", "dynamic")).json(path)


def split_quality(qc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-05, SNK-07, SNK-16: the good and bad views of one table with a reasons column."""
    return qc.filter(F.size("reasons") == 0), qc.filter(F.size("reasons") > 0)


def write_review(df: DataFrame, path: str) -> None:
    """SNK-09, AGG-43: CSV for people, arrays joined by ' || '."""
    text = {c: F.array_join(c, " || ") for c, k in df.dtypes if k == "array<string>"}
    df.withColumns(text).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report(df: DataFrame, meta: dict[str, str], counts: dict) -> DataFrame:
    """SNK-08: one row of JSON: meta and counts."""
    return df.agg(*[c.alias(k) for k, c in counts.items()]).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], *counts)).alias("report"))


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """SNK-13: what an earlier run hasn't written."""
    return df.join(done.select(key), key, "left_anti")


def complete(df: DataFrame, expected: int) -> bool:
    """SNK-14: whether the rows are all there."""
    return df.count() >= expected
