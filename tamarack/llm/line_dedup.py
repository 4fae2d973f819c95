"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines are hashed; windows that occur more than once anywhere in the corpus keep their first
occurrence, and every line that a later occurrence covers is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import free_name, staged
from tamarack.llm.exact_dedup import split_by_ids

LINES = 3


def _lines(text):
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, g, doc_id, pos): two hashes of each window that isn't blank, and where it begins."""
    lines = docs.select(F.col(id_col).alias("doc_id"), _lines(F.col(text_col)).alias("a")).filter(F.size("a") >= LINES)
    each = lines.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("a") - LINES), lambda i: F.concat_ws("\n", *[F.get("a", i + k) for k in range(LINES)]))).alias("pos", "w"))
    return each.filter(F.trim(F.translate("w", "\n", "")) != "").select(F.xxhash64("w").alias("h"), F.xxhash64(F.lit(7), "w").alias("g"), "doc_id", "pos")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lines): the places of the lines that later occurrences of repeated windows cover."""
    rows = windows(docs, id_col, text_col).filter("doc_id is not null")
    here = F.struct("doc_id", "pos")
    first = rows.groupBy("h", "g").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter("first <> last").select("h", "g", "first")
    later = rows.join(first, ["h", "g"]).filter(here > F.col("first"))
    at = later.select("doc_id", F.explode(F.array(*[F.col("pos") + k for k in range(LINES)])).alias("line")).distinct()
    return at.groupBy("doc_id").agg(F.collect_list("line").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines gone from its text, and columns n_lines and n_removed (replacing any of that name).

    Occurrences are ordered by id, then by place; windows of lines of spaces only never count. Null text stays null
    with no lines; a text of fewer than three lines stays as it is, and one that loses all its lines becomes empty.
    Rows with a null id stay as they are; rows that repeat an id are one document, and a window is not later than
    itself. An empty table gives an empty result. Only documents that may lose lines take part in a shuffle of texts.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed") and c not in (id_col, text_col)])
    gone = staged(covered_lines(docs, id_col, text_col).withColumnsRenamed({"doc_id": "__id", "lines": "__lines"}), "covered")
    maybe, rest = split_by_ids(docs, gone.select(F.col("__id").alias(id_col)), id_col)
    text = F.col(text_col)
    count = F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines")
    whole = rest.select(*docs.columns, count, F.lit(0).cast("long").alias("n_removed"))
    met = maybe.join(gone, F.col(id_col) == F.col("__id"), "left")

    def shortened(a: Column) -> Column:  # of lines split once: the text without the covered ones, and how many they were
        kept = F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("__lines"))
        return F.struct(F.array_join(F.transform(kept, lambda p: F.get(a, p)), "\n").alias("text"), (F.size(a) - F.size(kept)).cast("long").alias("n"))

    name = free_name(met.columns, "cut")
    met = met.withColumn(name, F.when(F.col("__lines").isNotNull() & text.isNotNull(), F.get(F.transform(F.array(_lines(text)), shortened), 0)))
    cut = met.select(
        *[F.when(F.col(name).isNull(), text).otherwise(F.col(name)["text"]).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        count, F.coalesce(F.col(name)["n"], F.lit(0)).cast("long").alias("n_removed"),
    )
    return whole.unionByName(cut)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = {
    "op9_line_dedup": """
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
w AS (SELECT doc_id, i, array_to_string(a[i : i + 2], chr(10)) AS w FROM (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS i FROM l)),
v AS (SELECT doc_id, i, w, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM w WHERE trim(replace(w, chr(10), '')) <> ''),
gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS line FROM v WHERE nth > 1),
e AS (SELECT doc_id, unnest(a) AS t, unnest(range(1, len(a) + 1)) AS line FROM l),
k AS (SELECT e.doc_id, count(*) AS n_lines, count(gone.line) AS n_removed,
             coalesce(string_agg(e.t, chr(10) ORDER BY e.line) FILTER (WHERE gone.line IS NULL), '') AS text
      FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.line = gone.line GROUP BY e.doc_id)
SELECT k.doc_id, CASE WHEN l.text IS NOT NULL THEN k.text END AS text, CASE WHEN l.text IS NULL THEN 0 ELSE k.n_lines END AS n_lines, k.n_removed
FROM k JOIN l USING (doc_id)
"""
}
