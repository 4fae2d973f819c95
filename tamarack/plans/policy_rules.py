"""Queries of the future-sampling policies and their window rules: models are stubs that say the source back without white space."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.plans.registry import query, spoken, table
from tamarack.streaming import sampling
from tamarack.streaming.policies import run_grouped

squeeze = sampling.squeeze


def _policy(spark: SparkSession, sf: str, policy: Callable[[], sampling.FutureSampling]) -> DataFrame:
    return spoken(run_grouped(table(spark, sf, "conversations"), policy, "conv_id", "turn", "text"))


def _forced(source: str, committed: str) -> str:
    """A translation that goes on from what is committed."""
    return committed + squeeze(source)[len(committed) :]


def _rest(source: str, committed: str) -> str:
    return squeeze(source)[len(committed) :]


#: Each turn with its text, the words and characters heard so far, and whether it is the last. Characters are counted without white space.
_HEARD = """WITH c AS (SELECT conv_id, turn, regexp_replace(text, '\\s', '', 'g') AS t, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last FROM conversations),
h AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS words, CAST(sum(length(t)) OVER w AS BIGINT) AS chars, string_agg(t, '') OVER w AS said FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _told(committed: str, said: str = "said") -> str:
    """SQL of a policy's output, from how much is committed after each turn and what would be written up to there."""
    return f"""{_HEARD}, s AS (SELECT *, {committed} AS upto FROM h),
d AS (SELECT *, greatest(0, upto - coalesce(max(upto) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS k FROM s),
e AS (SELECT *, CASE WHEN k > 0 THEN substr({said}, CAST(upto - k + 1 AS BIGINT), CAST(k AS BIGINT)) ELSE '' END AS delta FROM d)
SELECT conv_id, string_agg(CASE WHEN k > 0 THEN 'WRITE' ELSE 'READ' END, ' ' ORDER BY turn) AS actions, string_agg(delta, '|' ORDER BY turn) AS deltas, string_agg(delta, '' ORDER BY turn) AS prediction FROM e GROUP BY conv_id"""


@query(_told("CASE WHEN last OR words >= 20 THEN chars ELSE 0 END"))
def medoid_vote_policy(spark, sf):
    """STR-09: hypotheses part after what was heard, and the token before that is unlikely given the heard source alone."""

    def make():
        def score(observed, committed, ids):
            known = len(squeeze(observed)) - len(committed)
            return [(-0.1 if k < known else -9.0, 0.0) for k in range(len(ids))]

        return sampling.MedoidVote(
            lambda o: ["x1", "x2", "x3"], _forced, _rest, lambda texts: [[len(t), 1.0 + (t[-1] == "2")] for t in texts],
            lambda t: list(map(ord, t)), lambda ids: "".join(map(chr, ids)), score, least_words=20,
        )

    return _policy(spark, sf, make)


@query(_told("CASE WHEN last THEN chars ELSE chars + 1 END", "CASE WHEN last THEN said ELSE concat(said, 'x') END"))
def cluster_trie_policy(spark, sf):
    """STR-10: two of three futures form a cluster that shares one more character than was heard."""
    return _policy(spark, sf, lambda: sampling.ClusterTrie(lambda o: ["x1", "x2", "yz"], _forced, _rest, lambda texts: [[1.0, 0.0] if t[-1] in "12" else [0.0, 1.0] for t in texts]))


@query(_told("CASE WHEN last THEN chars ELSE chars - 3 END"))
def judged_policy(spark, sf):
    """STR-11: the judge holds the last three characters back."""
    return _policy(spark, sf, lambda: sampling.Judged(lambda o: ["x", "y"], _forced, _rest, lambda o, c, add, adds: len(add) - 3))


@query(_told("CASE WHEN last THEN chars ELSE least(chars - 3, 5 * words) END"))
def safe_delta_policy(spark, sf):
    """STR-14, STR-15, AGG-34: the last word heard is aligned near the end of the target, so the cap of five characters a word rules; links of one future go further."""

    def align(pairs):
        return [[(len(s.split()) - 2, len(t) - (4 if s.endswith("aa") else 3))] for s, t in pairs]

    return _policy(spark, sf, lambda: sampling.SafeDelta(lambda o: ["aa", "bb"], lambda o, f, c: _rest(o, c), _rest, align))


@query(_told("chars"))
def safe_delta_unchecked_policy(spark, sf):
    """STR-16."""
    return _policy(spark, sf, lambda: sampling.SafeDelta(lambda o: ["aa", "bb"], lambda o, f, c: _rest(o, c), _rest))


# Windows

_CASE = """SELECT doc_id, CAST(doc_id % 5 AS INT) AS observed, CAST(doc_id % 5 + doc_id % 7 AS INT) AS total, left(text, CAST(doc_id % 41 AS INT)) AS t,
list_transform(range(doc_id % 6), lambda i: (i + doc_id) % 5) AS s, list_transform(range(doc_id % 6), lambda i: (i * i * doc_id) % 23) AS g FROM documents"""


@query(f"""WITH c AS ({_CASE}), p AS (SELECT *, list_zip(s, g) AS z FROM c),
l AS (SELECT *, list_sort(list_transform(list_filter(z, lambda x: x[1] = observed - 1), lambda x: x[2])) AS hit, list_max(list_transform(list_filter(z, lambda x: x[1] < observed), lambda x: x[2])) AS far, greatest(2, 5 * observed) AS cap FROM p),
m AS (SELECT *, hit[len(hit) // 2 + 1] AS mid FROM l)
SELECT doc_id, CASE WHEN observed = 0 OR t = '' THEN '' WHEN len(hit) > 0 AND hit[-1] - hit[1] <= 12 AND mid >= 2 AND mid <= length(t) - 3 THEN left(t, least(mid + 1, cap)) WHEN far IS NOT NULL THEN left(t, least(far + 1, cap))
  WHEN floor(length(t) * (observed / total) * 0.8) >= 2 THEN left(t, CAST(floor(length(t) * (observed / total) * 0.8) AS BIGINT)) ELSE '' END AS kept FROM m WHERE t IS NOT NULL""")
def aligned_prefix(spark, sf):
    """WIN-18."""
    c = table(spark, sf, "documents").filter("text IS NOT NULL").selectExpr(
        "doc_id", "CAST(doc_id % 5 AS INT) AS observed", "CAST(doc_id % 5 + doc_id % 7 AS INT) AS total", "left(text, CAST(doc_id % 41 AS INT)) AS t",
        "IF(doc_id % 6 = 0, array(), transform(sequence(0L, doc_id % 6 - 1), i -> (i + doc_id) % 5)) AS s", "IF(doc_id % 6 = 0, array(), transform(sequence(0L, doc_id % 6 - 1), i -> (i * i * doc_id) % 23)) AS g",
    )

    @F.pandas_udf("string")
    def cut(total: pd.Series, observed: pd.Series, t: pd.Series, s: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([sampling.aligned_prefix(n, o, x, list(zip(a, b, strict=True))) for n, o, x, a, b in zip(total, observed, t, s, g, strict=True)], dtype=object)

    return c.select("doc_id", cut("total", "observed", "t", "s", "g").alias("kept"))


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS a, CAST(doc_id % 90 AS INT) AS heard, text AS t, CAST(doc_id % 300 AS INT) AS done FROM documents WHERE text IS NOT NULL),
v AS (SELECT *, least(heard, len(a)) AS n FROM w), o AS (SELECT *, greatest(0, n - 40) AS b, CASE WHEN n = 0 OR length(t) - greatest(0, done - 120) < 8 THEN 0 ELSE greatest(0, done - 120) END AS skip FROM v)
SELECT doc_id, CASE WHEN n = 0 THEN t ELSE array_to_string(a[b + 1:n + 24], ' ') END AS source, array_to_string(a[b + 1:n], ' ') AS heard, CAST(length(t) - skip AS BIGINT) AS n_near, CAST(skip AS INT) AS skip FROM o""")
def local_windows(spark, sf):
    """WIN-19."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").selectExpr("doc_id", "text", "CAST(doc_id % 90 AS INT) AS heard", "CAST(doc_id % 300 AS INT) AS done")

    @F.pandas_udf("source string, heard string, n_near long, skip int")
    def near(text: pd.Series, heard: pd.Series, done: pd.Series) -> pd.DataFrame:
        got = [sampling.local_windows(t, " ".join(t.split()[:h]), t, "c" * n) for t, h, n in zip(text, heard, done, strict=True)]
        return pd.DataFrame([(s, o, len(x), k) for s, o, x, k in got], columns=["source", "heard", "n_near", "skip"])

    return d.select("doc_id", near("text", "heard", "done").alias("v")).select("doc_id", "v.*")


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS a, CAST(doc_id % 13 AS INT) AS start, CAST(doc_id % 29 AS INT) AS heard FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(a[start + 1:], ' ') AS source, array_to_string(a[start + 1:heard], ' ') AS heard FROM w""")
def sentence_views(spark, sf):
    """WIN-24."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").selectExpr("doc_id", "text", "CAST(doc_id % 13 AS INT) AS start", "CAST(doc_id % 29 AS INT) AS heard")

    @F.pandas_udf("source string, heard string")
    def view(text: pd.Series, start: pd.Series, heard: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sampling.sentence_view(t, " ".join(t.split()[:h]), s) for t, s, h in zip(text, start, heard, strict=True)], columns=["source", "heard"])

    return d.select("doc_id", view("text", "start", "heard").alias("v")).select("doc_id", "v.*")
