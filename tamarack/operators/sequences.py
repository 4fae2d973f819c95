"""Runs, buckets, running prefixes, alignments, sampling and sharding (WIN-05..07, WIN-12..19, SRT-04..08, SRC-31..37, AGG-31..33)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions.text import append, running_joins


def running_pieces(df: DataFrame, key: str, order: str, piece: str) -> DataFrame:
    """WIN-05: what has been observed of each key up to each row: one fold a key, so the work is that of the texts written."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*[c for c in df.columns if c != key]).alias("row")))).alias("rows"))
    heard = F.transform("rows", lambda r: r["row"][piece])
    return rows.select(key, F.inline(F.zip_with("rows", running_joins(heard), lambda r, o: F.struct(r["row"].alias("row"), o.alias("observed"))))).select(*[F.col(key) if c == key else F.col("row")[c].alias(c) for c in df.columns], "observed")


def last_n(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """WIN-07: the last ``n`` values at each row, oldest first."""
    return df.withColumn("recent", F.collect_list(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)))


def recent_units(units: Column, observed: Column, n: int) -> Column:
    """WIN-06: the part of ``observed`` that its last ``n`` source units cover; all of it for n = 0."""
    if n <= 0:
        return observed
    through = F.aggregate(units, F.array().cast("array<string>"), lambda a, u: F.concat(a, F.array(append(F.coalesce(F.get(a, F.size(a) - 1), F.lit("")), u))))
    at = F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.size(units) - 1, F.lit(0))), lambda i: F.startswith(F.get(through, i), observed)), 0)
    before = F.coalesce(F.get(through, at - 1), F.lit(""))
    lead = F.aggregate(F.slice(units, F.greatest(F.lit(0), at - n + 1) + 1, F.greatest(F.lit(0), F.least(at, F.lit(n - 1)))), F.lit(""), append)
    part = F.when(F.startswith(observed, before), F.substr(observed, F.length(before) + 1)).otherwise(observed)
    return F.when((observed == "") | (F.size(units) == 0) | at.isNull(), observed).otherwise(append(lead, part))


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """WIN-12: adjacent rows with one value, as (key, run, value, first, n): gaps and islands over one sort."""
    w = Window.partitionBy(key).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    rows = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return rows.groupBy(key, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.count("*").alias("n"))


def half_open_bucket(x: Column, size: Column | int) -> Column:
    """WIN-13: k for x in (k size, (k + 1) size]; 0 for x = 0."""
    return F.greatest(F.lit(0), F.ceil(x / (F.lit(size) if isinstance(size, int) else size)) - 1).cast("int")


def monotone_alignment(pairs: Column, n_source: Column, n_target: Column) -> Column:
    """WIN-15, WIN-16: (s, t) pairs, an anchor (n_source - 1, n_target - 1) added, the last of each t kept, s never falling."""
    anchored = F.array_sort(F.transform(F.concat(pairs, F.array(F.struct((n_source - 1).cast("int").alias("s"), (n_target - 1).cast("int").alias("t")))), lambda p: F.struct(p["t"].alias("t"), p["s"].alias("s"))))

    def step(out: Column, p: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        top = F.greatest(p["s"], F.coalesce(last["s"], p["s"]))
        now = F.struct(top.alias("s"), p["t"].alias("t"))
        return F.when((F.size(out) > 0) & (last["t"] == p["t"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(now))).otherwise(F.concat(out, F.array(now)))

    return F.aggregate(anchored, F.array().cast("array<struct<s:int,t:int>>"), step)


def safe_target(pairs: Column, observed: Column) -> Column:
    """WIN-17: how many target units come before the first that is aligned to a source unit not yet observed."""
    late = F.array_min(F.transform(F.filter(pairs, lambda p: p["s"] >= observed), lambda p: p["t"]))
    early = F.filter(pairs, lambda p: (p["s"] < observed) & (late.isNull() | (p["t"] < late)))
    return F.coalesce(F.array_max(F.transform(early, lambda p: p["t"])) + 1, F.lit(0))


def _drawn(key: str, seed: int) -> Column:
    """An order that key and seed fix, in any engine."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """SRT-06: the ``n`` rows with the smallest hashes of key and seed."""
    return df.orderBy(_drawn(key, seed), key).limit(n)


def stratified_sample(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """SRT-07: the same in each stratum."""
    w = Window.partitionBy(by).orderBy(_drawn(key, seed), key)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def top_values(df: DataFrame, value: str, n: int) -> DataFrame:
    """SRT-04, SRT-05: the ``n`` most frequent values; ties fall to the smaller."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)


def block_shard(index: Column, total: int, parts: int) -> Column:
    """SRC-32, SRC-35: contiguous blocks of ceil(total / parts) rows."""
    return F.floor(index / max(1, -(-total // parts))).cast("int")


def modulo_shard(index: Column, parts: int, k: int) -> Column:
    """SRC-31."""
    return F.pmod(index, F.lit(parts)) == k


def medoids(df: DataFrame, key: str, item: str, vector: str) -> DataFrame:
    """AGG-31: (key, item): the vector with the least summed cosine distance to its group's.

    With unit vectors that sum is n minus the dot product with the group's summed vector, so no pairs are made: one
    pass adds up the vectors, one scores them. Ties fall to the smaller item.
    """
    norm = df.select(key, item, vector, F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm"))
    unit = norm.select(key, F.posexplode(vector).alias("d", "x"), "norm").select(key, "d", (F.col("x").cast("double") / F.col("norm")).alias("u"))
    centre = unit.groupBy(key, "d").agg(F.sum("u").alias("c")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda s: s["c"]).alias("centre"))
    dot = F.aggregate(F.zip_with(vector, "centre", lambda x, c: x.cast("double") * c), F.lit(0.0), lambda a, v: a + v)
    scored = norm.join(centre, key).select(key, item, (dot / F.col("norm")).alias("sim"))
    return scored.groupBy(key).agg(F.min_by(item, F.struct(-F.round("sim", 9), item)).alias(item))


def largest_cluster(vectors: np.ndarray, threshold: float = 0.25) -> np.ndarray:
    """AGG-32, AGG-33, for Arrow functions on one bounded candidate group: members of the largest average-linkage cosine cluster.

    Of equally large ones the tightest wins, then the one that holds the earliest row.
    """
    v = np.asarray(vectors, float)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    far = 1 - v @ v.T
    groups = [[k] for k in range(len(v))]
    while len(groups) > 1:
        d, a, b = min((far[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if d > threshold:
            break
        groups[a] += groups.pop(b)
    tight = lambda g: far[np.ix_(g, g)].sum() / max(1, len(g) * (len(g) - 1))
    return np.array(sorted(min(groups, key=lambda g: (-len(g), tight(g), min(g)))))


def clusters(df: DataFrame, key: str, item: str, vector: str, threshold: float = 0.25) -> DataFrame:
    """AGG-32 by group: (key, item) of each group's largest cluster. Groups are the candidates of one step, so they are small."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        return pdf.iloc[largest_cluster(np.stack(pdf[vector].to_list()), threshold)][[key, item]]

    return df.select(key, item, vector).groupBy(key).applyInPandas(run, df.select(key, item).schema)


def row_range(df: DataFrame, order: str, offset: int, count: int) -> DataFrame:
    """SRC-33, SRC-36: ``count`` rows from ``offset`` in ``order``."""
    return df.orderBy(order).offset(offset).limit(max(1, count))


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """SRC-37: the rows of one id; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))
