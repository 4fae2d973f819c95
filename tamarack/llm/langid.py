"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

The model is fitted in numpy by stochastic gradient descent on a bounded sample of labelled rows; prediction folds the
embeddings and the softmax weights into one table, so a text costs one gather per byte n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.llm.common import fold, slices, small_batches, tidy, unsigned_crc, utf8

BUCKETS = 8192
ORDERS = (2, 3, 4)
#: Bound on the rows that training takes: so many of each language, and so many languages.
SAMPLE_PER_LANG = 400
MAX_LANGS = 64
#: Rows of a language that are ranked, as a multiple of those taken; bytes of a text to learn from.
SPARE, SAMPLE_BYTES = 4, 1 << 16
#: Share of texts in the language they are labelled with that rejection may turn away on the calibration rows.
FALSE_REJECTS = 0.002
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # (BUCKETS + 1, langs): embedding times softmax weights; the last row is zero
    bias: np.ndarray
    temperature: float
    reject_below: float


def ngram_ids(buf: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the byte n-gram that begins at each byte; BUCKETS where it would leave its text."""
    n = len(buf)
    ids = np.full(n, BUCKETS, np.int32)
    if n >= order:
        h = np.zeros(n - order + 1, np.uint32)
        for k in range(order):
            h = h * np.uint32(0x01000193) + buf[k : n - order + 1 + k]
        h = (h ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        ids[: len(h)] = (h >> np.uint32(19)).astype(np.int32)
        for k in range(1, order):  # the last bytes of each text begin no whole n-gram
            at = off[1:] - k
            ids[at[(at >= off[:-1])]] = BUCKETS
    return ids


def _totals(length: np.ndarray) -> np.ndarray:
    return np.maximum(1, sum(np.maximum(0, length - k + 1) for k in ORDERS)).astype(np.float64)


def features(texts: list[str]) -> np.ndarray:
    """Mean n-gram counts of each text (rows by BUCKETS), for training."""
    buf, off, _ = utf8(pa.array(texts, pa.large_string()))
    buf = fold(buf)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    ids = [ngram_ids(buf, off, k) for k in ORDERS]
    for i in range(len(texts)):
        for x in ids:
            out[i] += np.bincount(x[off[i] : off[i + 1]], minlength=BUCKETS + 1)[:BUCKETS]
    return out / _totals(np.diff(off))[:, None].astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 30, rate: float = 4.0, batch: int = 32, seed: int = 7) -> LanguageModel:
    """Fit by SGD on four fifths of the rows; temperature and rejection threshold come from the rest.

    One language only is legal; without rows there are no languages, and every text is undetermined.
    """
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    x, y = features(texts), np.array([names.index(v) for v in langs])
    order = rng.permutation(len(y))
    cal, fit = order[: len(y) // 5], order[len(y) // 5 :]
    emb = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (dim, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    scale = np.float32(np.sqrt(BUCKETS) / 8)  # a mean over hundreds of n-grams is small
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            hid = x[at] @ emb * scale
            err = _softmax(hid @ out + bias)
            err[np.arange(len(at)), y[at]] -= 1
            err /= len(at)
            back = err @ out.T
            used = np.flatnonzero(x[at].any(0))
            out -= step * hid.T @ err
            bias -= step * 0.1 * err.sum(0)
            emb[used] -= step * scale * (x[at][:, used].T @ back)
    table = np.zeros((BUCKETS + 1, len(names)), np.float32)
    table[:BUCKETS] = emb @ out * scale
    temperature, below = 1.0, 0.0
    if len(cal) and len(names) > 1:
        logit = x[cal] @ table[:BUCKETS] + bias
        loss = lambda t: -np.log(_softmax(logit / t)[np.arange(len(cal)), y[cal]] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        p = _softmax(logit / temperature)
        right = p.max(1)[p.argmax(1) == y[cal]]
        if len(right):
            below = float(min(0.5, np.quantile(right, FALSE_REJECTS) * 0.9))
    return LanguageModel(names, table, bias, temperature, below)


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Train on at most ``per_lang`` rows of each of at most MAX_LANGS languages whose crc32(id) mod 5 is not 0.

    The rows are those with the smallest hashes of their ids, found on thin rows before any text is read. A language's
    count fixes a hash bound that some ``per_lang`` times SPARE rows are under, so that no task ranks a language's rows
    but these. Ids that repeat come after those that don't, and are taken with all their rows or not at all, so one of
    over ``per_lang`` rows never is. Texts of over SAMPLE_BYTES aren't learned from.
    """
    able = docs.filter((F.pmod(unsigned_crc(id_col), F.lit(5)) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    thin = able.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    seen = thin.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGS).collect()
    if not seen:
        return train([], [])
    below = F.create_map(*[F.lit(x) for r in seen for x in (r["l"], min(2**63 - 1, -(2**63) + 2**64 * SPARE * per_lang // r["n"]))])
    near = thin.filter(F.col("h") <= below[F.col("l")]).groupBy("l", "i", "h").agg(F.count("*").alias("m"))
    first = Window.partitionBy("l").orderBy("m", "h", "i").rowsBetween(Window.unboundedPreceding, 0)
    keys = near.withColumn("held", F.sum("m").over(first)).filter(F.col("held") <= per_lang).select("l", "i")
    short = able.filter(F.octet_length(text_col) <= SAMPLE_BYTES).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    rows = short.join(F.broadcast(keys), ["l", "i"], "left_semi").select("i", "l", "t").toPandas().sort_values(["i", "t"], kind="stable")
    return train(rows["t"].tolist(), rows["l"].tolist())


def predict_batch(model: LanguageModel, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, probability, rejected) of each text of an Arrow string array."""
    buf, off, _ = utf8(texts)
    n = len(off) - 1
    letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).combine_chunks() if isinstance(texts, pa.ChunkedArray) else pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
    if not model.langs:
        return [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
    logit = np.zeros((n, len(model.langs)))
    for i, j in slices(off):
        part, at = fold(buf[off[i] : off[j]]), off[i : j + 1] - off[i]
        full = np.flatnonzero(np.diff(at) > 0)
        if not len(full):
            continue
        for k in ORDERS:
            ids = ngram_ids(part, at, k)
            for c in range(len(model.langs)):
                logit[i + full, c] += np.add.reduceat(model.table[:, c][ids], at[:-1][full], dtype=np.float64)
    logit = logit / _totals(np.diff(off))[:, None] + model.bias
    p = _softmax(logit / model.temperature) if n else logit
    best = p.argmax(1) if n else np.zeros(0, int)
    top = p[np.arange(n), best] if n else np.zeros(0)
    lang = [model.langs[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
    return lang, np.where(letters, top, 0.0), ~letters | (top < model.reject_below)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id and ``carry`` columns with lang_pred, score and rejected, for whole texts.

    Null text, and text without a letter, is ``und`` with score 0 and rejected. Repeated rows are scored alike; an
    empty table gives an empty result. ``rejected`` also marks texts whose calibrated probability is under the
    model's threshold; their lang_pred is still the likeliest language.
    """
    keep = [id_col, *[c for c in carry if c != id_col]]
    src = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col(text_col).cast("string").alias("t"))

    def run(batches):
        for b in batches:
            lang, score, rejected = predict_batch(model, b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=[*[f"c{k}" for k in range(len(keep))], "lang_pred", "score", "rejected"])

    fields = [*[f"c{k} {src.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(keep))], "lang_pred string, score double, rejected boolean"]
    small_batches(docs.sparkSession)
    out = src.mapInArrow(tidy(run), ", ".join(fields))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with its columns; texts stay in their partitions."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            _, _, rejected = predict_batch(model, b.column(at))
            yield b.filter(pa.array(~rejected))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), schema)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs)
    held_out = F.pmod(unsigned_crc("doc_id"), F.lit(5)) == 0
    return identify_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
