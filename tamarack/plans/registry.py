"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions import metrics, parsing, prefixes
from tamarack.functions import text as T
from tamarack.operators import align, audit, scoring, segments, sequences, votes
from tamarack.streaming import policies

FLAGSHIP = "qe_filter_retention"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Scores


@query("""
SELECT lang AS latency, doc_id % 70 / 10.0 <= 3.0 AS kept, count(*) AS n
FROM documents GROUP BY ALL""")
def qe_filter_retention(spark, sf):
    """Score filter with retention by level (FLT-02, AGG-02)."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("latency"), (F.pmod("doc_id", F.lit(70)) / 10.0).alias("prediction"))
    return audit.status_counts(docs.withColumn("kept", scoring.passes(F.col("prediction"), 3.0)), "latency", "kept")


@query("""
SELECT doc_id, lang AS latency, n_chars, CAST(quality AS DOUBLE) AS prediction
FROM documents JOIN labels USING (doc_id) WHERE quality <= 0.5 AND lang IN ('en', 'de')""")
def qe_final_table(spark, sf):
    """Scores to stream rows (JOI-05, FLT-08)."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("latency"), "n_chars").filter(F.col("latency").isin("en", "de"))
    return scoring.final_table(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("prediction")), docs, ["doc_id"], 0.5)


@query("""
SELECT l_orderkey, max(l_discount) AS worst FROM lineitem GROUP BY l_orderkey HAVING max(l_discount) <= 0.08""")
def every_sentence_passes(spark, sf):
    """FLT-03."""
    return scoring.every_sentence_passes(table(spark, sf, "lineitem"), "l_orderkey", "l_discount", 0.08)


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90
FROM events GROUP BY event_type""")
def score_percentiles(spark, sf):
    """AGG-05."""
    s = scoring.summary(table(spark, sf, "events"), "value", "event_type")
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p10", "p25", "p50", "p75", "p90")])


@query("""
SELECT lang, round(avg(CAST(n_chars < 1500 AS INT)), 6) AS share FROM documents GROUP BY lang""")
def share_below(spark, sf):
    """AGG-06."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(scoring.share_below(F.col("n_chars"), 1500), 6).alias("share"))


@query("""
WITH a AS (SELECT doc_id, n_chars / 1000.0 AS s FROM documents WHERE lang <> 'fr'), b AS (SELECT doc_id, CAST(quality + toxic AS DOUBLE) AS s FROM labels)
SELECT CAST(count_if(a.s IS NOT NULL AND b.s IS NOT NULL) AS BIGINT) AS common, CAST(count_if(b.s IS NULL) AS BIGINT) AS only_a, CAST(count_if(a.s IS NULL) AS BIGINT) AS only_b,
       round(avg(a.s) FILTER (WHERE b.s IS NOT NULL), 6) AS mean_a, round(avg(b.s) FILTER (WHERE a.s IS NOT NULL), 6) AS mean_b,
       CAST(count_if(a.s < b.s) AS BIGINT) AS a_better, CAST(count_if(b.s < a.s) AS BIGINT) AS b_better
FROM a FULL JOIN b USING (doc_id)""")
def compare_scores(spark, sf):
    """JOI-11."""
    a = table(spark, sf, "documents").filter("lang <> 'fr'").select("doc_id", (F.col("n_chars") / 1000.0).alias("s"))
    b = table(spark, sf, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).cast("double").alias("s"))
    return scoring.compare(a, b, ["doc_id"], "s").withColumns({c: F.round(c, 6) for c in ("mean_a", "mean_b")})


@query("""
SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def latest_score(spark, sf):
    """JOI-11, SRC-09: of equal keys the last."""
    e = table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    return scoring.latest_score(e, ["user_id", "event_type"], "value", "o")


@query("""
SELECT user_id, CASE WHEN max(event_id) > min(event_id) THEN round(100.0 * (max(value) - min(value)) / (max(event_id) - min(event_id)), 6) ELSE 'nan'::DOUBLE END AS rate
FROM events GROUP BY user_id""")
def counter_hit_rate(spark, sf):
    """AGG-22."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(scoring.hit_rate(F.col("value"), F.col("event_id")), 6).alias("rate"))


# Presence, sets, status


@query("""
SELECT doc_id, a.doc_id IS NOT NULL AS in_left, b.doc_id IS NOT NULL AS in_right,
       concat_ws(',', CASE WHEN a.doc_id IS NULL THEN 'no_document' END, CASE WHEN b.doc_id IS NULL THEN 'no_label' END) AS reasons
FROM (SELECT doc_id FROM documents) a FULL JOIN (SELECT doc_id FROM labels) b USING (doc_id)""")
def full_outer_presence_reasons(spark, sf):
    """JOI-01, JOI-28."""
    p = audit.presence(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "no_document", "no_label")
    return p.withColumn("reasons", F.array_join("reasons", ","))


@query("""
SELECT d.doc_id, concat_ws(',', CASE WHEN l.doc_id IS NULL THEN 'no_label' END, CASE WHEN b.item_id IS NULL THEN 'no_item' END) AS reasons
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id""")
def left_outer_all_reasons(spark, sf):
    """JOI-02."""
    others = {"no_label": table(spark, sf, "labels"), "no_item": table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))}
    return audit.accumulate_reasons(table(spark, sf, "documents").select("doc_id"), "doc_id", others).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def good_semi(spark, sf):
    """JOI-03."""
    return audit.keep_listed(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").filter("quality = 1"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def used_anti(spark, sf):
    """JOI-16."""
    return audit.drop_used(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("""
SELECT CASE WHEN a.doc_id IS NULL THEN 'right_only' WHEN b.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n
FROM (SELECT doc_id FROM documents) a FULL JOIN (SELECT doc_id FROM labels) b USING (doc_id) GROUP BY 1""")
def set_ops_ids(spark, sf):
    """SET-01..03."""
    return audit.status_counts(audit.id_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id"), "side")


@query("""
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def ordered_distinct(spark, sf):
    """SET-06."""
    return audit.ordered_distinct(table(spark, sf, "documents"), F.col("text"), ["doc_id"]).select("doc_id", "source")


@query("""
SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)""")
def in_all_types(spark, sf):
    """JOI-27."""
    e = table(spark, sf, "events")
    return audit.in_all(e, "user_id", "event_type", e.select("event_type").distinct().count())


@query("""
SELECT user_id, event_type, min_by(value, (ts, event_id)) AS value, count(*) AS n_rows FROM events GROUP BY ALL""")
def first_wins_index(spark, sf):
    """SRC-13, SET-07."""
    return audit.one_of_each(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value", "n_rows")


@query("""
SELECT d.doc_id, coalesce(b.text, l.t) AS found FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id
LEFT JOIN (SELECT doc_id, 'quality ' || quality AS t FROM labels) l ON d.doc_id = l.doc_id""")
def resolve_first(spark, sf):
    """JOI-17."""
    a = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("found"))
    b = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("found"))
    return audit.resolve_first(table(spark, sf, "documents").select("doc_id"), "doc_id", [a, b], "found")


_VARIANT = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN lower(text) WHEN 2 THEN replace(text, '.', ' ') ELSE reverse(text) END"


@query(f"""
WITH v AS (SELECT doc_id, text AS m, {_VARIANT} AS f FROM documents),
c AS (SELECT doc_id, trim(regexp_replace(m, '\\s+', ' ', 'g')) AS m, trim(regexp_replace(f, '\\s+', ' ', 'g')) AS f FROM v),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(m), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')) AS nm,
                trim(regexp_replace(regexp_replace(lower(f), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')) AS nf FROM c)
SELECT doc_id, CASE WHEN f = m THEN 'exact' WHEN lower(f) = lower(m) THEN 'case' WHEN nf = nm THEN 'punct_only' ELSE 'mismatch' END AS status FROM n""")
def classify_source(spark, sf):
    """AGG-37, JOI-33."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.expr(_VARIANT).alias("f"))
    return d.select("doc_id", audit.classify_source(F.col("f"), F.col("text")).alias("status"))


@query("""
SELECT source, count(*) AS total, CAST(count_if(n_chars >= 1000) AS BIGINT) AS ok, CAST(count_if(n_chars < 1000) AS BIGINT) AS bad, round(count_if(n_chars < 1000) / count(*), 4) AS bad_rate
FROM documents GROUP BY ROLLUP (source)""")
def validator_rollup(spark, sf):
    """AGG-17, AGG-18."""
    return audit.ok_rollup(table(spark, sf, "documents"), "source", F.col("n_chars") >= 1000)


@query("""
SELECT event_type, event_id, value, rank FROM (SELECT event_type, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INT) AS rank FROM events) WHERE rank <= 5""")
def bounded_examples(spark, sf):
    """AGG-20: a top-k report."""
    return audit.examples(table(spark, sf, "events").select("event_type", "event_id", "value"), "event_type", "event_id", 5)


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 15")
def top_values(spark, sf):
    """SRT-04: a top-k report."""
    return sequences.top_values(table(spark, sf, "documents"), "source", 15)


@query("""
WITH s AS (SELECT range AS shard FROM range(8))
SELECT CAST(shard AS INT) AS shard, count(d.doc_id) AS rows, count(DISTINCT d.doc_id) AS docs FROM s LEFT JOIN documents d ON d.doc_id % 7 = s.shard GROUP BY shard""")
def shard_totals(spark, sf):
    """SNK-15, AGG-36."""
    return audit.shard_totals(table(spark, sf, "documents").withColumn("shard", F.pmod("doc_id", F.lit(7))), "shard", "doc_id", 8)


@query("""
SELECT doc_id, CAST(doc_id // ((SELECT count(*) + 7 FROM documents) // 8) AS INT) AS shard FROM documents""")
def block_shards(spark, sf):
    """SRC-32, SRC-35."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", sequences.block_shard(F.col("doc_id"), d.count(), 8).alias("shard"))


# Text


_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""
SELECT doc_id, n AS norm, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END AS n_tokens FROM (SELECT doc_id, {_NORM} AS n FROM documents)""")
def normalize_tokens(spark, sf):
    """SCL-01, SRC-12."""
    n = table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))
    return n.withColumn("n_tokens", F.when(F.col("norm") == "", 0).otherwise(F.regexp_count("norm", F.lit(" ")) + 1).cast("long"))


@query("SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')) AS norm FROM documents")
def letters_only(spark, sf):
    """SCL-02."""
    return table(spark, sf, "documents").select("doc_id", T.letters_only(F.col("text")).alias("norm"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM documents")
def collapse_whitespace(spark, sf):
    """SCL-04, MTH-03."""
    return table(spark, sf, "documents").select("doc_id", T.collapse(F.col("text")).alias("t"), T.nonspace_length(F.col("text")).cast("long").alias("n"))


@query("""
SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[.?!]')) >= 2 THEN 'no_target_sentence_end' ELSE '' END AS reason FROM documents""")
def punct_balance_flags(spark, sf):
    """FLT-11, SCL-10; these texts have no full-width marks."""
    return table(spark, sf, "documents").select("doc_id", T.zh_sentence_flag(F.col("text"), F.col("text"), 2).alias("reason"))


@query("""
SELECT metric, CAST(value AS INT) AS value, count(*) AS n FROM (
  SELECT unnest([{'metric': 'stop', 'value': len(regexp_extract_all(text, '[.]'))}, {'metric': 'comma', 'value': len(regexp_extract_all(text, ','))},
                 {'metric': 'diff', 'value': len(regexp_extract_all(text, '[.]')) - len(regexp_extract_all(text, ','))}], recursive := true) FROM documents)
GROUP BY ALL""")
def punct_histograms(spark, sf):
    """AGG-03, AGG-04."""
    stop, comma = T.count_chars(F.col("text"), "."), T.count_chars(F.col("text"), ",")
    return audit.histograms(table(spark, sf, "documents"), {"stop": stop, "comma": comma, "diff": stop - comma})


@query("""
WITH p AS (SELECT d.doc_id, d.text AS l, b.text AS r FROM documents d JOIN benchmark b ON d.doc_id = b.item_id),
a AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(l, '[\\p{L}\\p{N}_''\\s]', '', 'g'), '')) AS c FROM p) WHERE c <> '' GROUP BY ALL),
b AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(r, '[\\p{L}\\p{N}_''\\s]', '', 'g'), '')) AS c FROM p) WHERE c <> '' GROUP BY ALL),
d AS (SELECT doc_id, c, coalesce(a.n, 0) - coalesce(b.n, 0) AS d FROM a FULL JOIN b USING (doc_id, c))
SELECT doc_id, coalesce(string_agg(repeat(c, d), '' ORDER BY c) FILTER (WHERE d > 0), '') AS missing, coalesce(string_agg(repeat(c, -d), '' ORDER BY c) FILTER (WHERE d < 0), '') AS extra
FROM d WHERE d <> 0 GROUP BY doc_id""")
def punct_multiset_diff(spark, sf):
    """AGG-13..15."""
    p = table(spark, sf, "documents").select("doc_id", F.col("text").alias("l")).join(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("r")), "doc_id")
    return audit.punct_diff(p, "doc_id", "l", "r")


@query("""
WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
n AS (SELECT conv_id, turn, length(regexp_replace(text, '\\s', '', 'g')) AS h, length(regexp_replace(coalesce(prev, ''), '\\s', '', 'g')) AS r FROM t)
SELECT conv_id, turn, CASE WHEN h = 0 OR r = 0 THEN 'nan'::DOUBLE ELSE round(h / r, 9) END AS ratio, h > 0 AND r > 0 AND h / nullif(r, 0) BETWEEN 0.7 AND 1.5 AS in_band FROM n""")
def length_ratio(spark, sf):
    """MTH-04, FLT-04."""
    c = table(spark, sf, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    r = T.length_ratio(F.col("text"), F.col("prev"))
    return c.select("conv_id", "turn", F.round(r, 9).alias("ratio"), scoring.in_band(r).alias("in_band"))


@query("""
SELECT page_id, regexp_replace(url, '_[^_]*$', '') AS recording, left(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), 200) AS filename,
       regexp_extract(url || ':' || page_id || ':7', '^(.*):(\\d+):(\\d+)$', 1) AS path, CAST(regexp_extract(url || ':' || page_id || ':7', '^(.*):(\\d+):(\\d+)$', 2) AS BIGINT) AS start
FROM pages""")
def key_parse(spark, sf):
    """SCL-61..63."""
    spec = parsing.audio_spec(F.concat("url", F.lit(":"), F.col("page_id").cast("string"), F.lit(":7")))
    return table(spark, sf, "pages").select("page_id", parsing.recording_of(F.col("url")).alias("recording"), parsing.safe_filename(F.col("url")).alias("filename"), spec["path"].alias("path"), spec["start"].alias("start"))


@query("SELECT event_id, least(100.0, greatest(0.0, CAST(json_extract_string(props, '$.k') AS DOUBLE))) AS score FROM events")
def json_score(spark, sf):
    """SCL-38, SCL-49."""
    return table(spark, sf, "events").select("event_id", parsing.judge_score(F.col("props"), "k").alias("score"))


@query("""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
c AS (SELECT conv_id, turn, string_split(text, '') AS a, string_split(coalesce(prev, ''), '') AS b, least(length(text), length(coalesce(prev, ''))) AS n FROM p)
SELECT conv_id, turn, CASE WHEN n = 0 THEN 0 ELSE coalesce(list_position(list_transform(range(1, n + 1), lambda i: a[i] = b[i]), false) - 1, n) END AS lcp FROM c""")
def lcp_pairs(spark, sf):
    """SCL-66, MTH-07."""
    c = table(spark, sf, "conversations").withColumn("prev", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    return c.select("conv_id", "turn", prefixes.lcp_length(F.col("text"), F.col("prev")).cast("long").alias("lcp"))


@query("""
WITH f AS (SELECT doc_id // 8 AS g, lower(text) AS t FROM documents),
x AS (SELECT a.g, a.t, least(length(a.t), length(b.t)) AS n, string_split(a.t, '') AS p, string_split(b.t, '') AS q FROM f a JOIN f b ON a.g = b.g),
l AS (SELECT g, t, CASE WHEN n = 0 THEN 0 ELSE coalesce(list_position(list_transform(range(1, n + 1), lambda i: p[i] = q[i]), false) - 1, n) END AS l FROM x),
k AS (SELECT g, t, l, row_number() OVER (PARTITION BY g, t ORDER BY l DESC) AS r FROM l)
SELECT g, max(l) AS n FROM k WHERE r = 2 GROUP BY g""")
def quorum_prefix(spark, sf):
    """AGG-28, AGG-44: over groups of eight texts."""
    g = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 8).alias("g")).agg(F.collect_list(F.lower("text")).alias("f")).filter(F.size("f") > 1)
    return g.select("g", F.length(prefixes.quorum_prefix(F.col("f"), F.lit(2))).cast("long").alias("n"))


# Sequences and windows


@query("""
WITH m AS (SELECT user_id, epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS ms FROM events)
SELECT user_id, CAST(greatest(0, (ms + 959) // 960 - 1) AS INT) AS "window", count(*) AS n FROM m GROUP BY ALL""")
def tumbling_960ms(spark, sf):
    """WIN-02, on whole milliseconds."""
    return align.tumbling(_since_first(spark, sf), "user_id", "ms", 960, F.count("*"), dense=False)


def _since_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return e.withColumn("ms", F.col("at") - F.min("at").over(Window.partitionBy("user_id")))


@query("""
WITH m AS (SELECT user_id, epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS ms FROM events),
w AS (SELECT user_id, greatest(0, (ms + 3599999) // 3600000 - 1) AS w, count(*) AS n FROM m GROUP BY ALL),
d AS (SELECT user_id, unnest(range(0, max(w) + 1)) AS w FROM w GROUP BY user_id)
SELECT user_id, CAST(d.w AS INT) AS "window", coalesce(n, 0) AS n FROM d LEFT JOIN w USING (user_id, w)""")
def tumbling_dense(spark, sf):
    """WIN-01, with the empty windows."""
    return align.tumbling(_since_first(spark, sf), "user_id", "ms", 3_600_000, F.count("*")).withColumn("n", F.col("n").cast("long"))


@query("SELECT CAST(greatest(0, ceil(value / 5) - 1) AS INT) AS bucket, count(*) AS n FROM events GROUP BY 1")
def half_open_buckets(spark, sf):
    """WIN-13."""
    return audit.status_counts(table(spark, sf, "events").withColumn("bucket", sequences.half_open_bucket(F.col("value"), 5)), "bucket")


@query("""
WITH a AS (SELECT user_id, event_id, event_type, CAST(event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS INT) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(event_id) AS first, count(*) AS n FROM b GROUP BY user_id, run""")
def run_length_groups(spark, sf):
    """WIN-12."""
    return sequences.runs(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("""
SELECT conv_id, turn, trim(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn)) AS observed FROM conversations""")
def running_prefix(spark, sf):
    """WIN-05, SCL-20: these texts begin with letters and end in full stops, so all pieces are joined by spaces."""
    return sequences.running_pieces(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text").select("conv_id", "turn", "observed")


@query("""
SELECT conv_id, turn, string_agg(length(text)::VARCHAR, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM conversations""")
def last_n_window(spark, sf):
    """WIN-07."""
    c = table(spark, sf, "conversations").withColumn("n", F.length("text").cast("string"))
    return sequences.last_n(c, "conv_id", "turn", "n", 3).select("conv_id", "turn", F.array_join("recent", ",").alias("recent"))


@query("""
WITH r AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
g AS (SELECT conv_id, i // 2 AS k, string_agg(role, '' ORDER BY i) AS s FROM r GROUP BY ALL)
SELECT conv_id, string_agg(s, '|' ORDER BY k) AS grouped FROM g GROUP BY conv_id""")
def regroup_k(spark, sf):
    """WIN-09."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]).alias("a"))
    return c.select("conv_id", F.array_join(segments.regroup(F.col("a"), 2), "|").alias("grouped"))


@query("""
SELECT conv_id, turn, CAST(sum(CAST(length(trim(text)) > 0 AS INT)) OVER w AS INT) AS seen,
       CASE WHEN sum(CAST(length(trim(text)) > 0 AS INT)) OVER w >= 3 THEN 'WRITE' ELSE 'READ' END AS action
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def wait_k_actions(spark, sf):
    """STR-01, the part without a model."""
    return policies.wait_k_actions(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 3).drop("text")


@query("""
WITH c AS (SELECT doc_id, s, i FROM (SELECT doc_id, string_split(text, '. ') AS a FROM documents), unnest(a) WITH ORDINALITY AS u(s, i)),
w AS (SELECT *, len(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(s, '[.,?!:;-]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) <= 1 AS single FROM c),
g AS (SELECT *, sum(CAST(NOT single OR i = 1 AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w),
m AS (SELECT doc_id, k, string_agg(s, ' ' ORDER BY i) AS s FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS n, string_agg(s, '|' ORDER BY k) AS merged FROM m GROUP BY doc_id""")
def merge_short_chunks(spark, sf):
    """WIN-20: one-word sentences go to the one before."""
    a = F.split("text", "\\. ", -1)
    m = segments.merge_one_word(a, a)["en"]
    return table(spark, sf, "documents").select("doc_id", F.size(m).cast("long").alias("n"), F.array_join(m, "|").alias("merged"))


@query("""
WITH c AS (SELECT conv_id, turn, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations),
s AS (SELECT conv_id, unnest(range(0, 6)) AS sentence FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT c.conv_id, turn, CAST(coalesce(min(sentence) FILTER (WHERE x <= 60 * (sentence + 1)), 5) AS INT) AS sentence FROM c JOIN s USING (conv_id) GROUP BY c.conv_id, turn""")
def chunk_to_sentence(spark, sf):
    """JOI-26: six sentences of sixty words a conversation."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.size(T.tokens(F.col("text"))).alias("n"))
    s = c.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("sentence")).withColumn("end", (60 * (F.col("sentence") + 1)).cast("long"))
    return align.sentence_of_chunk(c, s, "conv_id", "turn", "n", "end")


@query("""
SELECT CAST(second AS INT) AS second, count(*) AS n FROM (SELECT unnest(range(CAST(floor(value) AS BIGINT), CAST(greatest(floor(value), ceil(value + 2.5) - 1) AS BIGINT) + 1)) AS second FROM events) GROUP BY second""")
def overlap_seconds(spark, sf):
    """JOI-23."""
    w = table(spark, sf, "events").select(F.col("value").alias("start"), (F.col("value") + 2.5).alias("end"))
    return audit.status_counts(align.overlapping_seconds(w), "second")


@query("""
WITH t AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> '') AS a FROM conversations),
p AS (SELECT conv_id, turn, a, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
SELECT conv_id, turn, array_to_string(list_transform(a, lambda x: coalesce(list_position(b, x), 0)), ',') AS places FROM p WHERE b IS NOT NULL""")
def naive_match(spark, sf):
    """JOI-20."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.word_tokens(F.col("text")).alias("a"))
    c = c.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("b is not null")
    return c.select("conv_id", "turn", F.array_join(align.naive_positions(F.col("a"), F.col("b")), ",").alias("places"))


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> '') AS a FROM conversations),
p AS (SELECT * FROM (SELECT conv_id, turn, a, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t) WHERE b IS NOT NULL),
g AS (SELECT conv_id, turn, a, b, 0 AS i, 0 AS z, '' AS places FROM p
  UNION ALL SELECT conv_id, turn, a, b, i + 1, z + q, concat(places, ',', CASE WHEN q > 0 THEN z + q ELSE 0 END) FROM (SELECT *, coalesce(list_position(b[z + 1:], a[i + 1]), 0) AS q FROM g WHERE i < len(a)))
SELECT conv_id, turn, substr(places, 2) AS places FROM g WHERE i = len(a)""")
def greedy_match(spark, sf):
    """JOI-18, JOI-22: a fold."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.word_tokens(F.col("text")).alias("a"))
    c = c.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("b is not null")
    return c.select("conv_id", "turn", F.array_join(align.greedy_positions(F.col("a"), F.col("b")), ",").alias("places"))


@query("""
WITH t AS (SELECT conv_id, turn, len(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_words, string_agg(e::VARCHAR, ',' ORDER BY turn) AS ends FROM (SELECT conv_id, turn, n, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM t) GROUP BY conv_id""")
def concat_sentences(spark, sf):
    """AGG-09, AGG-10."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.word_tokens(F.col("text")).alias("en"), F.lit(True).alias("ok"))
    g = segments.concat_sentences(c, "conv_id", "turn", ["en"], "ok")
    return g.select("conv_id", F.size("en").cast("long").alias("n_words"), F.array_join(F.transform("spans", lambda s: s["e"].cast("string")), ",").alias("ends"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS en, string_split(text, '. ') AS zh FROM documents),
r AS (SELECT unnest(list_filter([CASE WHEN len(en) <> len(zh) THEN 'length_mismatch' END,
  CASE WHEN len(list_filter(list_concat(en, zh), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g')) = '')) > 0 THEN 'blank_chunk' END,
  CASE WHEN len(en) > 1 AND len(list_filter(en, lambda s: len(regexp_extract_all(s, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) <= 1)) > 0 THEN 'one_word_chunk' END], lambda x: x IS NOT NULL)) AS reason FROM l)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def structure_reasons(spark, sf):
    """FLT-05, FLT-06, AGG-19."""
    d = table(spark, sf, "documents").select(segments.level_reasons(F.split("text", "\n", -1), F.split("text", "\\. ", -1), False, False).alias("reasons"))
    return audit.reason_counts(d)


# Votes: suppliers as tokens, line numbers as voters, orders in steps


_DIST = """WITH w AS (SELECT l_orderkey % 997 AS step, l_linenumber AS voter, l_suppkey % 12 AS token, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
d AS (SELECT step, voter, token, w / sum(w) OVER (PARTITION BY step, voter) AS p FROM w)"""


def _dist(spark, sf):
    w = table(spark, sf, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(997)).alias("step"), F.col("l_linenumber").alias("voter"), F.pmod("l_suppkey", F.lit(12)).alias("token")).agg(F.sum("l_quantity").alias("w"))
    return w.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("step", "voter"))).drop("w")


@query(f"{_DIST} SELECT step, voter, token, round(p, 9) AS p FROM (SELECT *, row_number() OVER (PARTITION BY step, voter ORDER BY p DESC, token) AS n FROM d) WHERE n <= 3")
def topk_candidates(spark, sf):
    """SRT-01."""
    return votes.candidates(_dist(spark, sf), ["step", "voter"], top_k=3).withColumn("p", F.round("p", 9))


@query(f"{_DIST} SELECT step, voter, token, round(p, 9) AS p FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY step, voter ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d) WHERE b < 0.63")
def topp_candidates(spark, sf):
    """WIN-08."""
    return votes.candidates(_dist(spark, sf), ["step", "voter"], top_p=0.63).withColumn("p", F.round("p", 9))


@query(f"{_DIST} SELECT step, voter, token, round(p, 9) AS p FROM d WHERE p >= 0.13")
def minp_candidates(spark, sf):
    """SRT-02."""
    return votes.candidates(_dist(spark, sf), ["step", "voter"], min_p=0.13).withColumn("p", F.round("p", 9))


@query(f"""{_DIST}, k AS (SELECT *, row_number() OVER (PARTITION BY step, voter ORDER BY p DESC, token) AS n FROM d),
v AS (SELECT step, count(DISTINCT voter) AS voters FROM d GROUP BY step),
t AS (SELECT step, token, count(*) AS c, sum(p) AS s FROM k WHERE n <= 9 GROUP BY ALL),
m AS (SELECT t.step, token, round(s / voters, 9) AS mean_p FROM t JOIN v USING (step) WHERE c = voters)
SELECT step, token, mean_p FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY mean_p DESC, token) AS r FROM m) WHERE r = 1""")
def intersection_vote(spark, sf):
    """AGG-24."""
    return votes.intersection_vote(_dist(spark, sf), ["step"], "voter", top_k=9).withColumn("mean_p", F.round("mean_p", 9))


@query(f"""{_DIST}, k AS (SELECT *, row_number() OVER (PARTITION BY step, voter ORDER BY p DESC, token) AS r FROM d WHERE p >= 0.05),
v AS (SELECT step, count(DISTINCT voter) AS voters FROM d GROUP BY step),
t AS (SELECT k.step, token, count(*) AS n, round(sum(p), 9) AS total_p FROM k WHERE r <= 20 GROUP BY ALL),
e AS (SELECT t.* FROM t JOIN v USING (step) WHERE n >= greatest(1, ceil(0.75 * voters)))
SELECT step, token, n, total_p FROM (SELECT *, row_number() OVER w AS q, lead(total_p) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY step ORDER BY total_p DESC, token)) WHERE q = 1 AND (nxt IS NULL OR nxt < total_p)""")
def soft_vote(spark, sf):
    """AGG-25."""
    return votes.soft_vote(_dist(spark, sf), ["step"], "voter", min_p=0.05).withColumn("total_p", F.round("total_p", 9))


@query("""
WITH w AS (SELECT conv_id, turn, u.i - 1 AS pos, u.t AS token FROM conversations, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) WITH ORDINALITY AS u(t, i)),
n AS (SELECT conv_id, pos, token, count(DISTINCT turn) AS n FROM w GROUP BY ALL), v AS (SELECT conv_id, count(DISTINCT turn) AS voters FROM w GROUP BY conv_id),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pos ORDER BY n DESC, token) AS k FROM n),
s AS (SELECT b.conv_id, pos, token, n, n / voters AS share FROM b JOIN v USING (conv_id) WHERE k = 1)
SELECT conv_id, pos, token, n, round(share, 9) AS share FROM (SELECT *, min(CAST(share >= 0.3 AS INT)) OVER (PARTITION BY conv_id ORDER BY pos) AS ok FROM s) WHERE ok = 1""")
def position_vote(spark, sf):
    """AGG-26: words of a conversation's turns, by place."""
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(T.tokens(F.lower("text"))).alias("pos", "token"))
    v = votes.position_vote(w, "conv_id", "turn", "pos", "token", 0.3, F.count_distinct("turn"))
    return v.select("conv_id", F.col("pos").cast("long").alias("pos"), "token", "n", F.round("share", 9).alias("share"))


@query("""
WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT label, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
d AS (SELECT label, i, sum(x) AS c FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM u) GROUP BY ALL),
c AS (SELECT label, list(c ORDER BY i) AS c FROM d GROUP BY label)
SELECT label, min_by(vec_id, (-round(list_dot_product(e, c), 9), vec_id)) AS vec_id FROM u JOIN c USING (label) GROUP BY label""")
def medoid(spark, sf):
    """AGG-31."""
    return sequences.medoids(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")


# Metrics and policies: models are stubs


@query()
def char_bleu(spark, sf):
    """MTH-02: each turn against the one before; held against a plain version in the tests."""
    c = table(spark, sf, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", metrics.char_bleu(F.col("text"), F.col("prev")).alias("bleu"))


#: Turns in capitals, as the stub model says them, with the words and characters so far. Spaces join the turns.
_SAID = """WITH c AS (SELECT conv_id, turn, upper(replace(text, 'ß', 'SS')) AS t, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations),
w AS (SELECT *, row_number() OVER p AS i, count(*) OVER (PARTITION BY conv_id) AS turns, CAST(sum(n) OVER p AS BIGINT) AS words, string_agg(t, ' ') OVER p AS said FROM c WINDOW p AS (PARTITION BY conv_id ORDER BY turn))"""


def _written(upto: str) -> str:
    """SQL of a policy's output, from how many characters are committed after each turn."""
    return f"""{_SAID}, v AS (SELECT *, last_value(said) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole FROM w),
s AS (SELECT *, CASE WHEN i = turns THEN length(whole) ELSE {upto} END AS upto FROM v),
d AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS before FROM s),
e AS (SELECT *, substr(whole, CAST(before + 1 AS BIGINT), CAST(upto - before AS BIGINT)) AS delta FROM d)
SELECT conv_id, string_agg(CASE WHEN upto > before THEN 'WRITE' ELSE 'READ' END, ' ' ORDER BY turn) AS actions, string_agg(delta, '|' ORDER BY turn) AS deltas, string_agg(delta, '' ORDER BY turn) AS prediction FROM e GROUP BY conv_id"""


def spoken(rows: DataFrame) -> DataFrame:
    """A policy's rows with actions and deltas as texts."""
    return rows.withColumns({"actions": F.array_join("actions", " "), "deltas": F.array_join("deltas", "|")})


@query(f"""{_SAID}, e AS (SELECT *, CASE WHEN i >= 3 THEN length(t) ELSE 0 END AS k FROM w),
s AS (SELECT conv_id, max(words) AS x, CAST(sum(k) AS BIGINT) AS y, CAST(sum(k * words) AS BIGINT) AS total, CAST(sum(length(replace(t, ' ', ''))) AS BIGINT) AS ref FROM e GROUP BY conv_id),
n AS (SELECT *, greatest(y, ref) AS n FROM s)
SELECT conv_id, CASE WHEN y = 0 THEN CAST('nan' AS DOUBLE) ELSE (total + (n - y) * x - x * (n - 1) / 2) / n END AS laal FROM n""")
def laal(spark, sf):
    """MTH-01: turns as source chunks, written back in capitals once three are there."""
    c = policies.wait_k_actions(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 3)
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "action"))).alias("r"))
    src, act = F.transform("r", lambda r: r["text"]), F.transform("r", lambda r: r["action"])
    out = F.transform("r", lambda r: F.when(r["action"] == "WRITE", F.upper(r["text"])).otherwise(""))
    return g.select("conv_id", metrics.laal(src, out, act, F.upper(F.array_join(src, ""))).alias("laal"))


class _Echo:
    """A stand-in for a translation model: capitals of what it hears."""

    @staticmethod
    def translate(observed: str, committed: str) -> str:
        return observed.upper()

    @staticmethod
    def complete(source: str, committed: str) -> str:
        return source.upper()[len(committed) :]


@query(_written("CASE WHEN i < 3 THEN 0 ELSE length(said) END"))
def wait_k_policy(spark, sf):
    """STR-01."""
    return spoken(policies.run_grouped(table(spark, sf, "conversations"), lambda: policies.WaitK(_Echo.translate, _Echo.complete, 3), "conv_id", "turn", "text"))


@query(_written("CASE WHEN i = 1 THEN length(said) ELSE lag(length(said)) OVER (PARTITION BY conv_id ORDER BY turn) END"))
def local_agreement_policy(spark, sf):
    """STR-02."""
    return spoken(policies.run_grouped(table(spark, sf, "conversations"), lambda: policies.LocalAgreement(_Echo.translate, _Echo.complete, 2), "conv_id", "turn", "text"))


@query(_written("12 * i + least(0, min(length(said) + 1 - 12 * i) OVER (PARTITION BY conv_id ORDER BY turn))"))
def consensus_policy(spark, sf):
    """STR-05..07, on characters as tokens."""

    def make():
        def dist(source, committed, pending):
            at, heard = len(committed) + len(pending), source.upper()
            return {ord(heard[at]): 1.0} if at < len(heard) else {}

        return policies.Consensus(lambda o: ["a", "b", "c", "d"], dist, lambda ids: "".join(map(chr, ids)), _Echo.complete)

    return spoken(policies.run_grouped(table(spark, sf, "conversations"), make, "conv_id", "turn", "text"))


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(doc_id, ':42')), doc_id) AS n FROM documents) WHERE n <= 20""")
def stratified_sample(spark, sf):
    """SRT-07: a sampling operator."""
    return sequences.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", 20, "doc_id")
