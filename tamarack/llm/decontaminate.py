"""Benchmark decontamination by q-gram lemma filtering.

An occurrence of an item of m bytes with at most k edits shares at least m - q + 1 - k q of the item's q-grams, all on
diagonals (place in the text less place in the item) within k of each other. Shared q-grams are counted in overlapping
bands of diagonals; regions that reach an item's bound are retained, and each is verified by a banded alignment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tamarack.llm.common import _power, fold, slices, small_batches, staged, tidy, utf8

Q = 8
#: Edits allowed, as a share of an item's normalised bytes.
BUDGET = 0.1
#: Items with fewer normalised bytes are too short for edits: they are looked for as they are, at word bounds, where asked for.
SHORTEST = 40
#: Benchmark bytes that one pass over the documents carries; more items take more passes, each a job of its own.
PASS_BYTES = 4 << 20
#: Pairs of a place in a text and one in an item that are looked at together.
PAIRS = 1 << 22
_TABLE_BITS = 22
_U = np.uint64


def normalise(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, and each run of ASCII white space as one space, none at either end of a text."""
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    keep = ~blank
    keep[:-1] |= ~blank[1:]  # of a run of blanks the last stays
    ends = off[1:][off[:-1] < off[1:]] - 1
    keep[ends] &= ~blank[ends]
    out = np.where(blank, np.uint8(32), fold(buf))
    at = np.concatenate([[0], np.cumsum(keep)])
    out, new = out[keep], at[off]
    lead = np.flatnonzero((new[:-1] < new[1:]) & (out[np.minimum(new[:-1], len(out) - 1)] == 32)) if len(out) else np.zeros(0, int)
    if len(lead):
        drop = np.zeros(len(out), bool)
        drop[new[lead]] = True
        shift = np.concatenate([[0], np.cumsum(drop)])
        out, new = out[~drop], new - shift[new]
    return out, new


def qgrams(buf: np.ndarray) -> np.ndarray:
    """The Q bytes from each place on, as one number."""
    if len(buf) < Q:
        return np.zeros(0, _U)
    out = np.zeros(len(buf) - Q + 1, _U)
    for k in range(Q):
        out |= buf[k : len(buf) - Q + 1 + k].astype(_U) << _U(8 * k)
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((g * _U(0x9E3779B97F4A7C15)) >> _U(64 - _TABLE_BITS)).astype(np.int64)


class Index:
    """The q-grams of a bounded set of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], short_items: bool = False):
        buf, off, _ = utf8(pa.array([t or "" for _, t in items], pa.large_string()))
        buf, off = normalise(buf, off)
        self.ids, self.text, grams, item, place = [], [], [], [], []
        short: dict[bytes, list] = {}
        for (i, _), a, b in zip(items, off[:-1], off[1:], strict=True):
            if b - a < SHORTEST:
                if short_items and b > a:
                    short.setdefault(buf[a:b].tobytes(), []).append(i)
                continue
            g = qgrams(buf[a:b])
            grams.append(g)
            item.append(np.full(len(g), len(self.ids)))
            place.append(np.arange(len(g)))
            self.ids.append(i)
            self.text.append(buf[a:b].copy())
        size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.floor(size * BUDGET).astype(np.int64)
        self.bound = np.maximum(1, size - Q + 1 - self.edits * Q)
        grams = np.concatenate(grams) if grams else np.zeros(0, _U)
        order = np.argsort(grams, kind="stable")
        self.gram = grams[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, int))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, int))[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_slot(self.gram)] = True
        # Some stretch of this length has at least this many shared q-grams wherever an item occurs within its budget.
        self.stretch = int((size + self.edits).min()) if len(size) else 0
        self.reach = int((size + self.edits).max()) if len(size) else 0
        self.least = min((max(1, int(-(-b // -(-int(s + e) // self.stretch)))) for b, s, e in zip(self.bound, size, self.edits, strict=True)), default=1)
        self.short: dict[int, tuple[np.ndarray, dict[bytes, list[int]]]] = {}
        for n in sorted({len(t) for t in short}):
            known: dict[bytes, list[int]] = {}
            for t in (t for t in short if len(t) == n):
                known[t] = list(range(len(self.ids), len(self.ids) + len(short[t])))
                self.ids += short[t]
            self.short[n] = np.unique(np.concatenate([_hashes(np.frombuffer(t, np.uint8), np.zeros(1, np.int64), n) for t in known])), known


def _hashes(buf: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of the ``n`` bytes from each of the given places."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, _U), np.cumsum((buf.astype(_U) + _U(1)) * _power("p", len(buf)), dtype=_U)])
        return (total[at + n] - total[at]) * _power("q", len(buf))[at]


def find_short(index: Index, buf: np.ndarray, off: np.ndarray, out: list[list[int]]) -> None:
    """Add to ``out`` the numbers of the short items that stand in each normalised text with no word going on at either end."""
    if not index.short or not len(buf):
        return
    word = (buf >= 128) | (buf == 95) | ((buf >= 48) & (buf <= 57)) | ((buf >= 97) & (buf <= 122))
    joined = np.zeros(len(buf) + 1, bool)  # whether a word goes on over the bound before a byte
    joined[1:-1] = word[1:] & word[:-1]
    joined[off] = False
    start = np.flatnonzero(~joined[:-1])
    row = np.searchsorted(off, start, side="right") - 1
    for n, (hashes, known) in index.short.items():
        fits = np.flatnonzero(start + n <= off[row + 1])
        fits = fits[~joined[start[fits] + n]]
        for j in fits[np.isin(_hashes(buf, start[fits], n), hashes)]:
            ks = known.get(buf[start[j] : start[j] + n].tobytes(), ())
            out[row[j]] += [k for k in ks if k not in out[row[j]]]


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int:
    """Least edits between ``item`` and any part of ``text`` along diagonals low..high, or ``most`` + 1 if they are more.

    Outside the text stand marks that equal no byte: matching one costs an edit, as leaving the item's byte out does.
    """
    before, after = max(0, -low), max(0, len(item) + high + 1 - len(text))
    wide = np.concatenate([np.full(before, 256, np.int16), text.astype(np.int16), np.full(after, 256, np.int16)])
    width = high - low + 1
    step = np.arange(width)
    row = np.zeros(width, np.int64)
    at = low + before
    for i, c in enumerate(item.tolist()):
        new = row + (wide[at + i : at + i + width] != c)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - step) + step
        if row.min() > most:
            return most + 1
    return int(row.min())


def _occurs(index: Index, k: int, text: np.ndarray, low: int, high: int) -> bool:
    item, e = index.text[k], int(index.edits[k])
    a, b = max(0, low - e), min(len(text), high + len(item) + e)
    part = text[a:b]
    return item.tobytes() in part.tobytes() or banded_distance(item, part, low - e - a, high + e - a, e) <= e


def find_items(index: Index, buf: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """For each normalised text, the numbers of the items that occur in it."""
    rows = len(off) - 1
    out: list[list[int]] = [[] for _ in range(rows)]
    if not len(index.gram) or len(buf) < Q:
        return out
    g = qgrams(buf)
    hit = index.table[_slot(g)]
    row_end = np.repeat(off[1:], np.diff(off))[: len(g)]
    hit &= np.arange(len(g)) + Q <= row_end
    total = np.concatenate([[0], np.cumsum(hit)])
    ahead = total[np.minimum(np.arange(len(g)) + index.stretch, len(g))] - total[:-1]
    dense = np.concatenate([[0], np.cumsum(ahead >= index.least)])
    pos = np.flatnonzero(hit)
    # An occurrence has a dense stretch, but its other hits may lie thinly: all within the longest item's length count.
    pos = pos[(dense[np.minimum(pos + index.reach, len(g))] - dense[np.maximum(0, pos + 1 - index.reach)]) > 0]
    if not len(pos):
        return out
    lo, hi = np.searchsorted(index.gram, g[pos], "left"), np.searchsorted(index.gram, g[pos], "right")
    upto = np.concatenate([[0], np.cumsum(hi - lo)])
    if upto[-1] <= PAIRS:
        for r, k, low, high, least in _bands(index, off, pos, lo, hi):
            if k not in out[r] and least >= index.bound[k] and _occurs(index, k, buf[off[r] : off[r + 1]], low, high):
                out[r].append(k)
        return out
    # Grams that a text and an item repeat over and over: the bands' counts are added up over parts of the places.
    total: dict[tuple[int, int, int, int], list[int]] = {}
    a = 0
    while a < len(pos):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
        for key, count, low, high in _counts(index, off, *_pairs(index, off, pos[a:b], lo[a:b], hi[a:b])):
            have = total.setdefault(key, [0, low, high])
            have[:] = have[0] + count, min(have[1], low), max(have[2], high)
        a = b
    for (_, r, k, _), (count, low, high) in total.items():
        if count >= index.bound[k] and k not in out[r] and _occurs(index, k, buf[off[r] : off[r + 1]], low, high):
            out[r].append(k)
    return out


def _pairs(index: Index, off: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(place in the buffer, entry of the index, row, diagonal) of each shared q-gram."""
    n = hi - lo
    at = np.repeat(pos, n)
    entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row = np.searchsorted(off, at, side="right") - 1
    return at, entry, row, at - off[row] - index.place[entry]


def _sorted_bands(index: Index, entry: np.ndarray, row: np.ndarray, diagonal: np.ndarray):
    """For each of the two sets of bands: its number, the pairs' order, the sorted (row, item, band), and where each begins and how many pairs it has.

    A band is twice as wide as an item's edits, and bands overlap by half.
    """
    item = index.item[entry]
    band = np.floor_divide(diagonal, index.edits[item] + 1)
    for shift in (0, 1):
        key = np.stack([row, item, np.floor_divide(band + shift, 2)])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        yield shift, order, key, new, np.diff(np.concatenate([new, [key.shape[1]]]))


def _bands(index: Index, off: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(row, item, least diagonal, largest one, places shared) of the bands that hold an item's bound of pairs."""
    at, entry, row, diagonal = _pairs(index, off, pos, lo, hi)
    for _, order, key, new, count in _sorted_bands(index, entry, row, diagonal):
        full = count >= index.bound[key[1, new]]
        for s, c in zip(new[full], count[full], strict=True):
            hits = order[s : s + c]
            ds = diagonal[hits]
            yield int(key[0, s]), int(key[1, s]), int(ds.min()), int(ds.max()), min(len(np.unique(at[hits])), len(np.unique(index.place[entry[hits]])))


def _counts(index: Index, off: np.ndarray, at: np.ndarray, entry: np.ndarray, row: np.ndarray, diagonal: np.ndarray):
    """((set of bands, row, item, band), pairs, least diagonal, largest one)."""
    for shift, order, key, new, count in _sorted_bands(index, entry, row, diagonal):
        ds = diagonal[order]
        for s, c, low, high in zip(new, count, np.minimum.reduceat(ds, new), np.maximum.reduceat(ds, new), strict=True):
            yield (shift, int(key[0, s]), int(key[1, s]), int(key[2, s])), int(c), int(low), int(high)


def benchmark_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", pass_bytes: int | None = None):
    """The benchmark's (id, text) rows in parts of about ``pass_bytes``, one after the other; the driver holds one at a time."""
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // (pass_bytes or PASS_BYTES)))
    for k in range(parts):
        yield [(r["i"], r["t"]) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).orderBy("i", "t").collect()], k + 1 == parts


def _matches(index: Index, column) -> list[list[int]]:
    buf, off, _ = utf8(column)
    out: list[list[int]] = []
    for i, j in slices(off):
        texts = normalise(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        found = find_items(index, *texts)
        find_short(index, *texts, found)
        out += found
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", short_items: bool = False) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids): the benchmark items that occur in each whole text with at most BUDGET edits a byte.

    Null and empty texts hold none; blank or null items are not looked for, and items shorter than SHORTEST are
    only with ``short_items``: exactly, and not within a word; equal items are all named, once for each
    id, in the order of their ids, a null id last. Ids may be of any type. Repeated rows are judged alike. An empty benchmark marks nothing, and an empty
    table gives an empty result; further columns aren't read.
    """
    small_batches(docs.sparkSession)
    now = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    item_type = benchmark.schema[item_col].dataType
    kind = f"doc_id {now.schema['doc_id'].dataType.simpleString()}, t string, item_ids array<{item_type.simpleString()}>"
    now = now.select("doc_id", "t", F.array().cast(f"array<{item_type.simpleString()}>").alias("item_ids"))
    arrow = pa.list_(to_arrow_type(item_type))

    def one_pass(items, last):
        def run(batches):
            index = Index(items, short_items)
            for b in batches:
                found = [have + [index.ids[k] for k in ks] for have, ks in zip(b.column(2).to_pylist(), _matches(index, b.column(1)), strict=True)]
                text = pa.nulls(b.num_rows, pa.string()) if last else b.column(1)
                yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(found, arrow)], names=["doc_id", "t", "item_ids"])

        return run

    for items, last in benchmark_parts(benchmark, item_col, item_text_col):
        now = now.mapInArrow(tidy(one_pass(items, last)), kind)
        if not last:
            now = staged(now, "pass")
    ordered = F.array_sort("item_ids")
    return now.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").alias("n_items"), ordered.alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", short_items: bool = False) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs (see :func:`contaminated`); texts stay in their partitions."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def one_pass(items):
        def run(batches):
            index = Index(items, short_items)
            for b in batches:
                yield b.filter(pa.array([not f for f in _matches(index, b.column(at))], pa.bool_()))

        return run

    for items, last in benchmark_parts(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(tidy(one_pass(items)), docs.schema)
        if not last:
            docs = staged(docs, "pass")
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark, short_items=True)
