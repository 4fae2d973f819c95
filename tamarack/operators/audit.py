"""Dataset audits: presence, status, punctuation and structure (JOI-01..17, JOI-27..33, AGG-01..20, AGG-35..37, SET-01..07, SRC-13, SNK-13, SNK-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions import text as T


def presence(left: DataFrame, right: DataFrame, key: str, no_left: str, no_right: str) -> DataFrame:
    """JOI-01, JOI-28: full outer: key, in_left, in_right, reasons."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))
    return both.withColumn("reasons", F.array_compact(F.array(F.when(~F.col("in_left"), no_left), F.when(~F.col("in_right"), no_right))))


def accumulate_reasons(base: DataFrame, key: str, others: dict[str, DataFrame]) -> DataFrame:
    """JOI-02: left joins; every missing side leaves its reason."""
    out = base
    for k, (_, df) in enumerate(others.items()):
        out = out.join(df.select(key).distinct().withColumn(f"__{k}", F.lit(1)), key, "left")
    reasons = F.array_compact(F.array(*[F.when(F.col(f"__{k}").isNull(), reason) for k, reason in enumerate(others)]))
    return out.select(*base.columns, reasons.alias("reasons"))


def keep_listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JOI-03, JOI-04: left semi."""
    return df.join(ids.select(key), key, "left_semi")


def drop_used(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """JOI-16, SNK-13: left anti."""
    return df.join(used.select(key), key, "left_anti")


def one_of_each(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """SRC-08, SRC-09, SRC-13, SRC-14, JOI-14, SET-07: the first row of each key in ``order``, or the last, with its count ``n_rows``."""
    cols = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    pick = F.max_by if last else F.min_by
    got = df.groupBy(*keys).agg(pick(F.struct(*cols), by).alias("r"), F.count("*").alias("n_rows"))
    return got.select(*keys, "r.*", "n_rows")


def resolve_first(df: DataFrame, key: str, candidates: list[DataFrame], column: str) -> DataFrame:
    """JOI-17, SRC-44: ``column`` from the first of several tables that has the key; null if none has."""
    out = df
    for k, c in enumerate(candidates):
        out = out.join(c.select(key, F.col(column).alias(f"__{k}")), key, "left")
    return out.select(*df.columns, F.coalesce(*[f"__{k}" for k in range(len(candidates))]).alias(column))


def in_all(df: DataFrame, key: str, group: str, groups: int) -> DataFrame:
    """JOI-27: keys that each of ``groups`` groups has (relational division)."""
    return df.groupBy(key).agg(F.count_distinct(group).alias("n")).filter(F.col("n") == groups).select(key)


def classify_source(final: Column, manifest: Column) -> Column:
    """AGG-37, JOI-07, JOI-33: no_manifest, exact, case, punct_only or mismatch."""

    def compared(p: Column) -> Column:  # collapsed once for all three tests
        a, b = p["a"], p["b"]
        return F.when(a == b, "exact").when(F.lower(a) == F.lower(b), "case").when(T.normalize(a) == T.normalize(b), "punct_only").otherwise("mismatch")

    both = F.array(F.struct(T.collapse(final).alias("a"), T.collapse(manifest).alias("b")))
    return F.when(manifest.isNull(), "no_manifest").when(final == manifest, "exact").otherwise(F.get(F.transform(both, compared), 0))


def status_counts(df: DataFrame, *by: str) -> DataFrame:
    """AGG-01, AGG-02, AGG-19."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def reason_counts(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    """AGG-19: rows for each reason."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def examples(df: DataFrame, by: str, order: str, most: int = 5) -> DataFrame:
    """AGG-20: the first ``most`` rows of each group: a bounded report."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("rank") <= most)


def histograms(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """AGG-03, AGG-04: (metric, value, n) of several whole-number columns in one pass and one aggregation."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("int").alias("value")) for m, c in metrics.items()])))
    return rows.groupBy("metric", "value").agg(F.count("*").alias("n"))


def ok_rollup(df: DataFrame, by: str, ok: Column) -> DataFrame:
    """AGG-17, AGG-18: total, ok, bad and bad rate by group, and for all (a null group)."""
    return df.rollup(by).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"), F.round(F.count_if(~ok) / F.count("*"), 4).alias("bad_rate"))


def punct_counts(df: DataFrame, key: str, column: str) -> DataFrame:
    """AGG-13: (key, char, n) of the punctuation in a text."""
    chars = F.filter(F.split(T.punctuation_only(F.col(column)), ""), lambda c: c != "")
    return df.select(key, F.explode(chars).alias("char")).groupBy(key, "char").agg(F.count("*").alias("n"))


def punct_diff(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """AGG-14, AGG-15: (key, missing, extra): punctuation that ``left`` has over ``right`` and the reverse, sorted and repeated."""
    a, b = punct_counts(df, key, left).withColumnRenamed("n", "a"), punct_counts(df, key, right).withColumnRenamed("n", "b")
    d = a.join(b, [key, "char"], "full_outer").select(key, "char", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).cast("int").alias("d")).filter("d <> 0")

    def side(sign: int) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("d") * sign > 0, F.struct("char", (F.col("d") * sign).alias("n"))))), lambda s: F.repeat(s["char"], s["n"])), "")

    return d.groupBy(key).agg(side(1).alias("missing"), side(-1).alias("extra"))


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """SET-01..03: (key, side): left_only, right_only or both."""
    return presence(left, right, key, "l", "r").select(key, F.when(F.col("in_left") & F.col("in_right"), "both").when(F.col("in_left"), "left_only").otherwise("right_only").alias("side"))


def ordered_distinct(df: DataFrame, value: Column, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """SET-06: the first row of each value, without regard to case, in ``order``."""
    w = Window.partitionBy(*by, F.lower(value)).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def not_contained(values: Column, other: Column) -> Column:
    """SET-09: values whose normal form isn't inside that of ``other``."""
    return F.filter(values, lambda v: ~F.contains(T.normalize(other), T.normalize(v)))


def shard_totals(df: DataFrame, shard: str, doc: str, expected: int) -> DataFrame:
    """SNK-15, AGG-16, AGG-36: by shard of 0..expected-1: rows and distinct documents; a missing shard has zeros."""
    all_ = df.sparkSession.range(expected).select(F.col("id").cast("int").alias(shard))
    got = df.groupBy(F.col(shard).cast("int").alias(shard)).agg(F.count("*").alias("rows"), F.count_distinct(doc).alias("docs"))
    return all_.join(got, shard, "left").na.fill(0, ["rows", "docs"])


def value_map(df: DataFrame, key: str, name: str, value: str, order: str) -> DataFrame:
    """JOI-25: (key, name, value): by key, the value that stands last for each name."""
    return df.groupBy(key, name).agg(F.max_by(value, order).alias(value))


def in_three(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """JOI-09: the rows of three tables that share a key."""
    return a.join(b, key).join(c, key)
