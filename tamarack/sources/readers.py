"""Readers for manifests, JSON trees, JSONL, TextGrid alignments, transcripts, traces and score files (SRC-*)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.parsing import latency_of_name, list_literal, token_id
from tamarack.functions.text import blank, normalize, strip, word_tokens

#: Fixed marks of silence and of words the aligner didn't know.
SILENCE = ("", "sil", "sp")
UNKNOWN = ("unk", "spn")
MANIFEST = "id string, audio string, n_frames string, speaker string, src_lang string, tgt_lang string, asr string, src_text string, src_text_full string, src_trajectory string"


def read_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-01..03: a TSV with a header, all text, '' kept apart from null; columns by the header unless ``schema`` is given."""
    r = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000")
    return (r.schema(schema) if schema else r).csv(path)


def manifest_lists(df: DataFrame, *columns: str) -> DataFrame:
    """Cells that hold list literals, as arrays."""
    return df.withColumns({c: list_literal(F.col(c)) for c in columns})


def read_json_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-05, SRC-06, SRC-15: one JSON object a file, with file_path, utt (from the name), lang and pq (from the folders; null elsewhere)."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(path).withColumn("file_path", F.col("_metadata.file_path"))
    layout = "/([^/]+)/(\\d{8})/[^/]+$"
    return df.withColumns({"utt": F.regexp_extract("file_path", "([^/]+)\\.json$", 1), "lang": F.nullif(F.regexp_extract("file_path", layout, 1), F.lit("")), "pq": F.nullif(F.regexp_extract("file_path", layout, 2), F.lit(""))})


def read_jsonl(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """SRC-07, SRC-39, SRC-42: a JSON object a line, with file_path and bad_line; blank lines are skipped, bad ones keep their text in raw."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    parsed = lines.filter(F.trim("value") != "").select("file_path", "value", F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull() | ~F.col("value").rlike("^\\s*\\{")
    return parsed.select("r.*", "file_path", bad.alias("bad_line"), F.when(bad, F.col("value")).alias("raw")).drop("__bad")


def with_latency(df: DataFrame) -> DataFrame:
    """SRC-08, SRC-17, SRC-40, SRC-41: the record's latency, else the file name's."""
    have = F.col("latency") if "latency" in df.columns else F.lit(None).cast("string")
    return df.withColumn("latency", F.coalesce(F.nullif(have, F.lit("")), latency_of_name(F.col("file_path"))))


def parse_textgrid(text: str | None, tier: str = "words") -> tuple[list[tuple[str, float, float]], float | None]:
    """(word, start, end) of a long or short TextGrid's tier, blank intervals left out, and the grid's end time."""
    if not text:
        return [], None
    body = re.sub(r"(?m)^\s*(?:intervals|item|points)\s*\[\d*\]:?", " ", text)
    tokens = re.findall(r'"(?:[^"]|"")*"|(?<![\w.])-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?', body)
    end, out = None, []
    try:
        at = next(k for k, t in enumerate(tokens) if t[0] != '"')
        end = float(tokens[at + 1])
        k = at + 2
        while k < len(tokens):
            if tokens[k] in ('"IntervalTier"', '"TextTier"'):
                name, n = tokens[k + 1].strip('"'), int(tokens[k + 4])
                width = 3 if tokens[k] == '"IntervalTier"' else 2
                if name == tier and width == 3:
                    for j in range(k + 5, k + 5 + 3 * n, 3):
                        if word := tokens[j + 2][1:-1].replace('""', '"').strip():
                            out.append((word, float(tokens[j]), float(tokens[j + 1])))
                    break
                k += 5 + width * n
            else:
                k += 1
    except (StopIteration, IndexError, ValueError):
        return [], None
    return out, end if end is not None else (out[-1][2] if out else None)


def read_textgrids(spark: SparkSession, path: str, tier: str = "words") -> DataFrame:
    """SRC-10, SRC-43: (utt, file_path, words array<struct(word, start, end)>, duration)."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.TextGrid").option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file_path"), "value")

    @F.pandas_udf("words array<struct<word:string,start:double,end:double>>, duration double")
    def parse(s: pd.Series) -> pd.DataFrame:
        got = [parse_textgrid(x, tier) for x in s]
        return pd.DataFrame({"words": [[{"word": w, "start": a, "end": b} for w, a, b in g[0]] for g in got], "duration": [g[1] for g in got]})

    rows = files.withColumn("g", parse("value"))
    return rows.select(F.regexp_extract("file_path", "([^/]+)\\.TextGrid$", 1).alias("utt"), "file_path", "g.words", "g.duration")


def aligned_tokens(words: Column) -> Column:
    """SRC-11: normalised tokens without silence, from an array of words."""
    return F.filter(F.flatten(F.transform(words, lambda w: F.split(normalize(w), " "))), lambda t: ~t.isin(*SILENCE))


def unknown_token(words: Column) -> Column:
    """The first word the aligner didn't know, raw or normalised; null if there is none."""
    return F.get(F.filter(words, lambda w: normalize(w).isin(*UNKNOWN) | F.lower(w).isin("<unk>", "<eps>")), 0)


def read_labs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: (utt, tokens) of whole transcript files."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.lab").option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)\\.lab$", 1).alias("utt"), "value")
    return df.select("utt", word_tokens(F.col("value")).alias("tokens"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """SRC-22: (metric, value) of a TSV; rows without a number are left out."""
    cells = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(cells) >= 2).select(strip(F.get(cells, 0)).alias("metric"), F.get(cells, 1).try_cast("double").alias("value")).filter("value is not null")


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """SRC-21."""
    return spark.read.schema("index long, prediction string, delays array<double>, elapsed array<double>, source_length double").json(path)


def score_grid(scores: DataFrame, models: DataFrame, segments: DataFrame, metrics: list[str]) -> DataFrame:
    """SRC-45: each model and segment with a column a metric; NaN where a score is missing. The grid is of two bounded dimensions."""
    wide = scores.groupBy("model", "segment").pivot("metric", metrics).agg(F.first("value"))
    grid = models.withColumn("segment", F.explode(F.array(*[F.lit(r[0]) for r in segments.select("segment").distinct().collect()])))
    return grid.join(wide, ["model", "segment"], "left").na.fill(float("nan"), metrics)


def prefix_cache_counters(c: Column, queries: str = "prefix_cache_queries", hits: str = "prefix_cache_hits") -> Column:
    """SRC-30: struct(queries, hits) from a Prometheus page; zeros where they are missing."""
    def value(name: str) -> Column:
        return F.coalesce(F.regexp_extract(blank(c), f"(?m)^[\\w:]*{name}(?:_total)?(?:\\{{[^}}]*\\}})?\\s+([0-9.eE+-]+)", 1).try_cast("double"), F.lit(0.0))

    return F.struct(value(queries).alias("queries"), value(hits).alias("hits"))


def guess_column(columns: list[str], patterns: list[str]) -> str | None:
    """SRC-26: the first column that the earliest pattern fits."""
    return next((c for p in patterns for c in columns if re.search(p, c, re.I)), None)


def distribution_rows(df: DataFrame, keys: list[str], logprobs: str) -> DataFrame:
    """SCL-45 as rows: (keys, token, p) of a {'token_id:N': log probability} map."""
    return df.select(*keys, F.explode(logprobs).alias("k", "lp")).select(*keys, token_id(F.col("k")).alias("token"), F.exp("lp").alias("p")).filter("token is not null")


_TRACE_STEP = re.compile(r"step=(\d+)\s+accepted='(.*?)'(?:\s+pending='(.*?)')?")
_TRACE_FUTURE = re.compile(r"future\[(\d+)\]\s*(?:\((\w+)\))?:\s*'(.*)'")


def parse_trace(text: str | None) -> tuple[dict[str, str], list[dict]]:
    """SRC-23, SRC-24: header and chunks (with futures and steps) of a verbose trace."""
    header: dict[str, str] = {}
    chunks: list[dict] = []
    key = None
    for line in (text or "").splitlines():
        if line.startswith("#"):
            m = re.match(r"#\s*(\w[\w ]*?)\s*:\s?(.*)", line)
            if m:
                key = m[1]
                header[key] = m[2]
            elif key:
                header[key] += line.lstrip("# ")
        elif m := re.match(r"\s*Chunk\s+(\d+)/(\d+)", line):
            chunks.append({"chunk": int(m[1]), "of": int(m[2]), "futures": [], "steps": []})
        elif chunks and (m := _TRACE_FUTURE.search(line)):
            chunks[-1]["futures"].append({"i": int(m[1]), "sampler": m[2] or "primary", "text": m[3]})
        elif chunks and (m := _TRACE_STEP.search(line)):
            chunks[-1]["steps"].append({"step": int(m[1]), "accepted": m[2], "pending": m[3] or ""})
    return header, chunks


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, header map, chunks) of trace files, each parsed by one task."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file_path"), "value")
    kind = "file_path string, header map<string,string>, chunks array<struct<chunk:int,of:int,futures:array<struct<i:int,sampler:string,text:string>>,steps:array<struct<step:int,accepted:string,pending:string>>>>"

    def run(frames):
        for f in frames:
            got = [parse_trace(v) for v in f["value"]]
            yield pd.DataFrame({"file_path": f["file_path"], "header": [g[0] for g in got], "chunks": [g[1] for g in got]})

    return files.mapInPandas(run, kind)
