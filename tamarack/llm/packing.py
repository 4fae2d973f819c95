"""Sum-of-squares packing of token sequences.

Each piece goes to the open bin (or a new one) that makes the sum over residual gaps of (open bins with that gap)
squared smallest. Tokenising gives a narrow table of pieces; groups of pieces of bounded size are packed one by one, and
the bins that end up badly filled are packed again, together, until no group is left with more than its last few.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import drop_staged, kept, small_batches, staged, tidy

CAPACITY = 2048
#: Pieces that one task packs; a bound on its memory, not on the input.
GROUP = 60_000
#: Cached words of a worker; the cache is emptied when it is full.
CACHE = 400_000
TRAILING = ".,!?;:%$&*#|"
TOKENIZER = "byte_bpe_50k.json"
#: Bins filled less than this are packed again with those of the other groups.
WELL_FILLED = 0.985
END = np.array([0], "<u4").tobytes()


def _byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


BYTE_CHARS = _byte_chars()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters(word: str) -> bool:
    """Whether a word is of letters alone that all versions of Unicode agree on."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class _Words(dict):
    """Ids of words that follow ``lead``, worked out when first met.

    Letters, the punctuation after them and a lone newline are tokens' borders for the pre-tokeniser, so a word splits
    there; what isn't of that form is encoded as it stands.
    """

    def __init__(self, enc: Encoder, lead: str):
        super().__init__()
        self.enc, self.lead = enc, lead

    def __missing__(self, w: str) -> bytes:
        if "\n" in w and all(parts := w.split("\n")) and parts == w.split():
            return self[parts[0]] + b"".join(self.enc.newline + self.enc.first[p] for p in parts[1:])
        core = w.rstrip(TRAILING)
        if core != w and _letters(core):
            ids = self[core] + self.enc.suffix(w[len(core) :])
        elif _letters(core):
            ids = np.array([t.id for t in self.enc.model.tokenize("".join(map(BYTE_CHARS.__getitem__, (self.lead + w).encode())))], "<u4").tobytes()
        else:
            ids = self.enc.plain(self.lead + w)
        if len(self) >= CACHE:
            self.clear()
        self[w] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A byte-level pre-tokeniser never joins what lies on both sides of a single space that has a word after it, so a
    text is the concatenation of its words' ids; each different word is encoded once and then looked up. A text that
    holds one of the vocabulary's added tokens (such as an end mark) is encoded as a whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.first, self.rest = _Words(self, ""), _Words(self, " ")
        self.newline = self.plain("\n")
        self.suffixes: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def suffix(self, text: str) -> bytes:
        if (ids := self.suffixes.get(text)) is None:
            ids = self.plain(text)
            if len(self.suffixes) < CACHE // 8:
                self.suffixes[text] = ids
        return ids

    @staticmethod
    def words(text: str) -> list[str]:
        parts = text.split(" ")
        if all(parts) and not any(p[0].isspace() for p in parts):
            return parts
        out = [parts[0]]  # a space before white space, or at the end, is no border
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self.plain(text)
        head, *rest = self.words(text)
        return (self.first[head] if head else b"") + b"".join(map(self.rest.__getitem__, rest))


_encoders: dict[str, Encoder] = kept("packing")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids: all full, but for a shorter first one where it doesn't divide."""
    head = total % capacity
    starts = ([0] if head else []) + list(range(head, total, capacity))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], total], strict=True)]


def piece_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids, with the end id 0 after the last.

    Null text is empty: one piece of one id. Repeated rows are tokenised each for itself.
    """
    path = path or tokenizer_path()
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for b in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                ids = b.column(0)
                took, out = [], ([], [], [], [])
                for r, text in enumerate(b.column(1).to_pylist()):
                    data = enc.encode(text) + END
                    for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                        took.append(r)
                        for col, v in zip(out, (k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(took, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return src.mapInArrow(tidy(run, "packing"), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, in the given order, and the fill of each bin.

    With N(g) open bins of gap g, putting an item of size s in a bin of gap g changes the sum of squares by
    2 (N(g-s) - N(g)) + 2, or by 2 N(capacity-s) + 1 for a new bin; a bin that becomes full leaves the sum. Of equal
    changes the smallest gap wins, and a new bin loses.
    """
    n = np.zeros(capacity + 1, np.int64)
    bins: dict[int, list[int]] = defaultdict(list)
    fill: list[int] = []
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    far = np.iinfo(np.int64).max // 4
    for i, s in enumerate(lengths):
        s = int(s)
        have, after = n[s:capacity], n[: capacity - s]
        best, at = far, 0
        if len(have):
            change = np.where(have > 0, 2 * (after - have) + 2, far)
            change[0] = 1 - 2 * have[0] if have[0] else far  # gap s: the bin is full, and leaves
            at = int(change.argmin())
            best = int(change[at])
        fresh = 2 * int(n[capacity - s]) + 1 if s < capacity else 0
        if best < far and best <= fresh:
            gap = at + s
            b = bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b = capacity, len(fill)
            fill.append(0)
        place[i], offset[i] = b, fill[b]
        fill[b] += s
        if left := gap - s:
            bins[left].append(b)
            n[left] += 1
    return place, offset, fill


def _pack_groups(pieces: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Pack each of ``groups`` hash groups: adds sequence_id, offset and the bin's fill."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    salt = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "piece", F.lit(turn)), F.lit(groups)).cast("int")
    schema = pieces.select(*keys).schema.add("sequence_id", "long").add("offset", "long").add("fill", "long")

    def run(key, table):
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        place, offset, fill = sum_of_squares(table.column("length").to_numpy(), capacity)
        base = (turn << 56) | (key[0].as_py() << 28)
        return pa.table([*(table.column(k) for k in keys), pa.array(place + base), pa.array(offset), pa.array(np.asarray(fill, np.int64)[place] if len(place) else place)], names=[*keys, "sequence_id", "offset", "fill"])

    return pieces.select(*keys, salt.alias("g")).groupBy("g").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document, each in one sequence.

    Sequences hold at most ``capacity`` ids, without gaps from 0. An empty table gives an empty result; null text is a
    document of one id. Rows that repeat an id are documents of their own.
    """
    pieces = staged(piece_table(docs, id_col, text_col, path, capacity), "pieces")
    done, turn = [], 1
    while True:
        n = pieces.count()
        groups = max(1, -(-n // group))
        packed = staged(_pack_groups(pieces, groups, turn, capacity), "packed")
        if groups == 1 or turn >= 100:
            done.append(packed)
            break
        done.append(packed.filter(F.col("fill") >= int(capacity * WELL_FILLED)))
        drop_staged(pieces)
        pieces = staged(packed.filter(F.col("fill") < int(capacity * WELL_FILLED)).drop("sequence_id", "offset", "fill"), "loose")
        turn += 1
        if pieces.count() > 0.8 * n:  # packing again gains little: these stay as they are
            done[-1] = packed
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("fill")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
