"""Votes over candidate distributions and token sequences (AGG-24..27, SRT-01..03, SRT-10, WIN-08, SET-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def candidates(dist: DataFrame, keys: list[str], top_p: float = 0.0, min_p: float = 0.0, top_k: int = 0, token: str = "token", p: str = "p") -> DataFrame:
    """SRT-01..03, WIN-08: the rows of each distribution that a policy keeps: top-p, else min-p, else top-k. Ties fall to the smaller token."""
    order = Window.partitionBy(*keys).orderBy(F.col(p).desc(), F.col(token))
    if top_p > 0:
        before = F.coalesce(F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        return dist.withColumn("__b", before).filter(F.col("__b") < top_p).drop("__b")
    if min_p > 0:
        return dist.filter(F.col(p) >= min_p)
    return dist.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= top_k).drop("__n")


def intersection_vote(dist: DataFrame, step: list[str], voter: str, token: str = "token", p: str = "p", **policy) -> DataFrame:
    """AGG-24, SET-04: by step, the token that every voter keeps with the largest mean probability; none if there is no such token."""
    voters = dist.groupBy(*step).agg(F.count_distinct(voter).alias("voters"))
    kept = candidates(dist, [*step, voter], token=token, p=p, **policy)
    total = kept.groupBy(*step, token).agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    able = total.join(voters, step).filter("n = voters").withColumn("mean_p", F.col("s") / F.col("voters"))
    best = Window.partitionBy(*step).orderBy(F.col("mean_p").desc(), F.col(token))
    return able.withColumn("__n", F.row_number().over(best)).filter("__n = 1").select(*step, token, "mean_p")


def soft_vote(dist: DataFrame, step: list[str], voter: str, token: str = "token", p: str = "p", min_p: float = 0.1, top_k: int = 20, ratio: float = 0.75) -> DataFrame:
    """AGG-25: among tokens that max(1, ceil(ratio * voters)) voters give ``min_p`` or more, the one with the strictly largest sum."""
    voters = dist.groupBy(*step).agg(F.count_distinct(voter).alias("voters"))
    kept = candidates(dist.filter(F.col(p) >= min_p), [*step, voter], top_k=top_k, token=token, p=p)
    total = kept.groupBy(*step, token).agg(F.count("*").alias("n"), F.sum(p).alias("total_p")).join(voters, step).filter(F.col("n") >= F.greatest(F.lit(1), F.ceil(F.lit(ratio) * F.col("voters"))))
    order = Window.partitionBy(*step).orderBy(F.col("total_p").desc(), F.col(token))
    ranked = total.withColumn("__n", F.row_number().over(order)).withColumn("__next", F.lead("total_p").over(order))
    return ranked.filter((F.col("__n") == 1) & (F.col("__next").isNull() | (F.col("__next") < F.col("total_p")))).select(*step, token, "n", "total_p")


def position_vote(tokens: DataFrame, key: str, voter: str, pos: str, token: str, threshold: float, voters: Column, start: int = 0) -> DataFrame:
    """AGG-26: at each place from ``start`` the most voted token, while its share of all ``voters`` stays at ``threshold``; stops at the first place that fails."""
    n = tokens.filter(F.col(pos) >= start).groupBy(key, pos, token).agg(F.count_distinct(voter).alias("n"))
    best = n.withColumn("__k", F.row_number().over(Window.partitionBy(key, pos).orderBy(F.col("n").desc(), F.col(token)))).filter("__k = 1")
    shared = best.join(tokens.groupBy(key).agg(voters.alias("voters")), key).withColumn("share", F.col("n") / F.col("voters"))
    run = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.min((F.col("share") >= threshold).cast("int")).over(run) == 1
    dense = F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1 + start == F.col(pos)
    return shared.withColumn("__ok", ok & dense).filter("__ok").select(key, pos, token, "n", "share")


def safe_prefix_length(logprobs: Column, margins: Column, least: float = -2.0, most: float = 1.5) -> Column:
    """SRT-10: how many leading tokens have a log probability of ``least`` or more and a margin of ``most`` or less."""
    ok = F.zip_with(logprobs, margins, lambda a, b: (a >= least) & (b <= most))
    bad = F.array_position(ok, False)
    return F.when(bad > 0, bad - 1).otherwise(F.size(ok)).cast("int")


def trie_vote(translations: list[str], committed: str, threshold: float, voters: int, least: int) -> str:
    """AGG-27, for Arrow functions: characters after ``committed`` that ``threshold`` of ``voters`` share along one path; '' if fewer than ``least``."""
    alive = [t[len(committed) :] for t in translations if t.startswith(committed)]
    out = ""
    while True:
        count: dict[str, int] = {}
        for t in alive:
            if len(t) > len(out):
                count[t[len(out)]] = count.get(t[len(out)], 0) + 1
        if not count:
            break
        c = min(count, key=lambda x: (-count[x], x))
        if count[c] / max(1, voters) < threshold:
            break
        out += c
        alive = [t for t in alive if t.startswith(out)]
    return out if len(out) >= least else ""
