"""Quality classifier: random Fourier features of document statistics, ridge from partition-summed normal equations, isotonic calibration.

Texts are read once, into a narrow table of statistics; fitting and scoring work on that table. Each partition adds up
its own normal equations, so what reaches the driver is a few fixed-size matrices, however many labels there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import fold, slices, small_batches, staged, unsigned_crc, utf8, words

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "line_share", "stop", "comma", "bang", "symbol", "pipe", "quote",
    "non_ascii", "adjacent_repeat", "distinct_words", "capital_words", "short_words", "long_words", "distinct_lines", "mean_line", "top_byte_run",
)
WIDTH = 256
RIDGE = 1e-3
#: Score bins for isotonic calibration: what it aggregates is bounded by this.
BINS = 1024
#: Matrices that meet at the driver.
FAN_IN = 8


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    rows = len(off) - 1
    out = np.zeros((rows, len(STATISTICS)))
    length = np.diff(off)
    full = np.flatnonzero(length > 0)
    if not len(full):
        return out
    at = off[:-1][full]

    def share(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), at) / length[full]

    cols: dict[str, np.ndarray] = {"log_bytes": np.log1p(length[full])}
    upper = (buf >= 65) & (buf <= 90)
    lower = fold(buf)
    letter = (lower >= 97) & (lower <= 122)
    digit = (buf >= 48) & (buf <= 57)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    stop, comma, high = buf == 46, (buf == 44) | (buf == 59) | (buf == 58), buf >= 128
    bang, pipe, quote = (buf == 33) | (buf == 63), buf == 124, (buf == 34) | (buf == 39) | (buf == 45)
    cols |= {"upper": share(upper), "digit": share(digit), "space": share(blank), "line_share": share(buf == 10), "stop": share(stop), "comma": share(comma), "bang": share(bang), "pipe": share(pipe), "quote": share(quote), "non_ascii": share(high)}
    cols["symbol"] = share(~(letter | digit | blank | stop | comma | high | bang | pipe | quote))
    same = np.zeros(len(buf), bool)
    same[1:] = buf[1:] == buf[:-1]
    same[off[:-1][full]] = False
    cols["top_byte_run"] = share(same)
    h, row, size = words(lower, off)
    n = np.bincount(row, minlength=rows).astype(float)
    per = np.maximum(n, 1)
    by_row = lambda x: np.bincount(row, weights=x, minlength=rows)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    begin = np.concatenate([[0], np.cumsum(n).astype(np.int64)])
    distinct = np.array([len(np.unique(h[begin[r] : begin[r + 1]])) for r in range(rows)], float)
    word_start = np.zeros(len(buf) + 1, bool)
    word_start[:-1] = ~blank
    word_start[1:-1] &= blank[:-1]
    word_start[off[:-1][full]] = ~blank[off[:-1][full]]
    cols["capital_words"] = np.add.reduceat((upper & word_start[:-1]).astype(np.int32), at) / per[full]
    every = {"log_words": np.log1p(n), "mean_word": by_row(size) / per, "adjacent_repeat": by_row(again) / per, "distinct_words": distinct / per, "short_words": by_row(size <= 3) / per, "long_words": by_row(size >= 12) / per}
    # Lines, hashed as runs between newlines: the same kernel, with every other blank seen as a letter.
    lh, lrow, lsize = words(np.where(buf == 10, np.uint8(10), np.where(blank, np.uint8(1), buf)).astype(np.uint8), off)
    ln = np.bincount(lrow, minlength=rows).astype(float)
    lbegin = np.concatenate([[0], np.cumsum(ln).astype(np.int64)])
    every["distinct_lines"] = np.array([len(np.unique(lh[lbegin[r] : lbegin[r + 1]])) for r in range(rows)], float) / np.maximum(ln, 1)
    every["mean_line"] = np.log1p(np.bincount(lrow, weights=lsize, minlength=rows) / np.maximum(ln, 1))
    for k, name in enumerate(STATISTICS):
        if name in cols:
            out[full, k] = cols[name]
        else:
            out[:, k] = np.where(length > 0, every[name], 0)
    return out


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<float>): the statistics of each whole text; null text counts as empty."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def run(batches):
        for b in batches:
            buf, off, _ = utf8(b.column(1))
            x = np.zeros((b.num_rows, len(STATISTICS)))
            for i, j in slices(off):
                x[i:j] = statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            flat = pa.array(x.astype(np.float32).ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(STATISTICS)), flat)], names=["id", "x"])

    small_batches(docs.sparkSession)
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, x array<float>")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _partition_sums(df: DataFrame, one) -> np.ndarray | None:
    """Sum over partitions of what ``one`` (batch columns to a vector) gives: each partition sends one vector, FAN_IN tasks add those."""

    def gather(batches):
        total = None
        for b in batches:
            if b.num_rows and (v := one(b)) is not None:
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def add(batches):
        total = None
        for b in batches:
            for v in b.column(0):
                v = np.frombuffer(v.as_py())
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    rows = df.mapInArrow(gather, "v binary").repartition(FAN_IN).mapInArrow(add, "v binary").collect()
    return sum(np.frombuffer(bytes(r["v"])) for r in rows) if rows else None


@dataclass
class QualityModel:
    mean: np.ndarray
    std: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores
    values: np.ndarray  # calibrated scores at the knots

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.std) @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores that depend on a row alone: sums in a fixed order, where a matrix product's order depends on the rows beside it."""
        x, width, out = (x - self.mean) / self.std, len(self.phases), np.empty(len(x))
        for k in range(0, len(x), 256):
            angle = np.tile(self.phases, (len(x[k : k + 256]), 1))
            for column, direction in zip(x[k : k + 256].T, self.directions, strict=True):
                angle += column[:, None] * direction
            out[k : k + 256] = (np.cos(angle) * (self.weights[:width] * np.sqrt(2 / width))).sum(1) + self.weights[width]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(score: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and a non-decreasing fit, joined by straight lines."""
    blocks: list[list[float]] = []  # weight, weighted mean of labels, weighted mean of scores
    for s, w, m in zip(score, weight, mean, strict=True):
        blocks.append([w, m, s])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, s2 = blocks.pop()
            w1, m1, s1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), (w1 * s1 + w2 * s2) / (w1 + w2)]
    return np.array([b[2] for b in blocks]), np.array([b[1] for b in blocks])


def fit_quality_model(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", width: int = WIDTH, seed: int = 11) -> QualityModel:
    """Fit on the labelled rows whose crc32(id) mod 3 is 0 (ridge) and 2 (calibration); remainder 1 is never read.

    Null labels are ignored. With labels of no row, or one class, the model gives that class's share everywhere
    (0.5 without labels).
    """
    dim = len(STATISTICS)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    rest = F.pmod(unsigned_crc("id"), F.lit(3))
    rows = staged(table.join(known, "id").select("x", "y", rest.cast("int").alias("fold")).filter("fold <> 1"), "quality-train")
    moments = _partition_sums(rows.filter("fold = 0").select("x", "y"), lambda b: np.concatenate([[b.num_rows], (x := _matrix(b.column(0))).sum(0), (x**2).sum(0), [np.asarray(b.column(1)).sum()]]))
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(dim, width)) / np.sqrt(dim), rng.uniform(0, 2 * np.pi, width)
    if moments is None:
        return QualityModel(np.zeros(dim), np.ones(dim), directions, phases, np.zeros(width + 1), np.array([0.0]), np.array([0.5]))
    n = moments[0]
    mean = moments[1 : dim + 1] / n
    std = np.sqrt(np.maximum(moments[dim + 1 : 2 * dim + 1] / n - mean**2, 1e-8))
    model = QualityModel(mean, std, directions, phases, np.zeros(width + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def normal(b):
        z, y = model.expand(_matrix(b.column(0))), np.asarray(b.column(1), np.float64)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _partition_sums(rows.filter("fold = 0").select("x", "y"), normal)
    a, c = sums[: (width + 1) ** 2].reshape(width + 1, width + 1), sums[(width + 1) ** 2 :]
    model.weights = np.linalg.solve(a + RIDGE * n * np.eye(width + 1) / 10, c)

    def histogram(b):
        s, y = model.raw(_matrix(b.column(0))), np.asarray(b.column(1), np.float64)
        k = np.clip(((s + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(k, w, BINS) for w in (np.ones(len(s)), y, s)])

    held = _partition_sums(rows.filter("fold = 2").select("x", "y"), histogram)
    if held is None:
        return model
    count, ones, score = held.reshape(3, BINS)
    at = np.flatnonzero(count)
    model.knots, model.values = isotonic(score[at] / count[at], count[at], ones[at] / count[at])
    return model


def score_quality(table: DataFrame, model: QualityModel) -> DataFrame:
    """(id, score) from a statistics table."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))) if b.num_rows else np.zeros(0), pa.float64())], names=["id", "score"])

    return table.select("id", "x").mapInArrow(run, f"id {table.schema['id'].dataType.simpleString()}, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    table = staged(statistics_table(docs), "quality-statistics")
    scored = score_quality(table, fit_quality_model(table, labels))
    return scored.select(F.col("id").alias("doc_id"), (F.pmod(unsigned_crc("id"), F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
