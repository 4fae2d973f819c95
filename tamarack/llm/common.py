"""Helpers that the corpus operators share: staged tables, Arrow text buffers, word and shingle hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for the ASCII-only folding that the contracts ask for.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of text that the numpy kernels expand at a time (a longer single text is still taken whole).
SLICE_BYTES = 1 << 19
_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and all run on one machine (tests)."""
    conf = spark.sparkContext.getConf()
    if not (where := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tamarack.shared.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tamarack-")
        spark.conf.set("tamarack.shared.dir", where)
        atexit.register(shutil.rmtree, where.removeprefix("file://"), ignore_errors=True)
    return where.rstrip("/")


#: Rows of whole texts that go to Python at a time.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends BATCH_ROWS rows at most to Python at a time, for texts may be long; a lower setting stands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What ``owner`` keeps in a Python worker from task to task, until a task of another owner begins there."""
    return _kept.setdefault(owner, {})


def forget_others(owner: str) -> None:
    """Empty what all but ``owner`` keep in this process."""
    if full := [d for k, d in _kept.items() if k != owner and d]:
        for d in full:
            d.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system: the allocators would hold it, and Spark uses a worker again for stage after stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def tidy(run, owner: str = ""):
    """``run``, a function for mapInArrow, with no more memory left in the worker before and after it than ``owner`` keeps."""

    def tidied(batches):
        forget_others(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the program ends."""
    path = f"{shared_dir(spark)}/tamarack/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a :func:`staged` table that nothing reads any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/tamarack/" in folder:
            _delete(df.sparkSession, folder)


def free_name(taken, base: str) -> str:
    """A column name that clashes, in any letter case, with none of ``taken``."""
    used = {c.lower() for c in taken}
    name, k = base, 0
    while name.lower() in used:
        k += 1
        name = f"{base}_{k}"
    return name


def unsigned_crc(col):
    """CRC-32 of a value's text form."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def utf8(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is-null) of an Arrow string array; a null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    null = np.asarray(column.is_null())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    buf = buf[off[0] : off[-1]]
    return buf, off - off[0], null


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges [i, j) whose texts have about ``most`` bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def fold(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_P, _PINV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, _P if which == "p" else _PINV, _U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=_U)
        _powers[which] = have
    return have[:n]


def words(buf: np.ndarray, off: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes outside ``[\\x20\\x09-\\x0D]`` in each text: (64-bit hash, row of the text, byte length).

    A run's hash is a polynomial over its bytes, taken from one prefix sum over the whole buffer, then mixed.
    """
    n = len(buf)
    if n == 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (buf != 32) & ((buf < 9) | (buf > 13))
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    begin = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    end = np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum((buf.astype(_U) + _U(1 + 131 * (seed % 1000))) * _power("p", n), out=total[1:])
        h = (total[end] - total[begin]) * _power("q", n)[begin]
        h = mix(h + _U((seed * 0x2545F4914F6CDD1D + 0x632BE59BD9B4E019) & (2**64 - 1)) + (end - begin).astype(_U))
    return h, np.searchsorted(off, begin, side="right") - 1, end - begin


def shingles(h: np.ndarray, row: np.ndarray, rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words of one text, and the row of each; a text with fewer words gives its whole sequence as one."""
    n = np.bincount(row, minlength=rows)
    start = np.concatenate([[0], np.cumsum(n)])
    out, rows_out = [], []
    with np.errstate(over="ignore"):
        if len(h) >= width:
            s = np.zeros(len(h) - width + 1, _U)
            for k in range(width):
                s += h[k : len(h) - width + 1 + k] * _U((0x9FB21C651E98DF25 * (2 * k + 1) + 2 * k) & (2**64 - 1) | 1)
            s = mix(s + _U(width))
            ok = row[: len(s)] == row[width - 1 :]
            out.append(s[ok])
            rows_out.append(row[: len(s)][ok])
        few = np.flatnonzero((n > 0) & (n < width))
        if len(few):
            got = np.empty(len(few), _U)
            for j, r in enumerate(few):
                x = _U(n[r])
                for v in h[start[r] : start[r + 1]]:
                    x = mix(np.asarray([x * _U(0x9E3779B97F4A7C15) + v + _U(77)], _U))[0]
                got[j] = x
            out.append(got)
            rows_out.append(few)
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    s, r = np.concatenate(out), np.concatenate(rows_out)
    if len(out) > 1:
        order = np.argsort(r, kind="stable")
        s, r = s[order], r[order]
    return s, r
