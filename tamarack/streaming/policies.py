"""Read/write policies as step functions, with a batch and a streaming runner (STR-01..08, STR-17, STR-25, WIN-05..07, FLT-19, FLT-20).

A policy sees an utterance's chunks in order and answers each with one (action, delta); the last chunk completes the
translation. Models are injected: ``translate(observed, committed)`` gives a whole hypothesis that starts with what is
committed, ``complete(source, committed)`` the rest. State is small and belongs to one utterance, so utterances run in
parallel and a lost one is replayed from its chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

READ, WRITE = "READ", "WRITE"
BEFORE, AFTER = ",.!?;:)]}\"'", "([{\"'"


def join_chunks(chunks: list[str]) -> str:
    """SCL-20 on the Python side."""
    out = ""
    for c in filter(None, chunks):
        loose = out and not out[-1].isspace() and not c[0].isspace() and c[0] not in BEFORE and out[-1] not in AFTER
        out += (" " if loose else "") + c
    return out.strip()


def common_prefix(texts: list[str], words: bool = False) -> str:
    if len(texts) < 2:
        return texts[0] if texts else ""
    lists = [t.split() if words else t for t in texts]
    n = next((k for k, xs in enumerate(zip(*lists, strict=False)) if len(set(xs)) > 1), min(map(len, lists)))
    return " ".join(lists[0][:n]) if words else lists[0][:n]


@dataclass
class State:
    chunks: list[str] = field(default_factory=list)
    committed: str = ""
    history: list[str] = field(default_factory=list)


class Policy:
    """Subclasses answer a chunk that isn't the last."""

    def __init__(self, translate: Callable[[str, str], str], complete: Callable[[str, str], str]):
        self.translate, self.complete = translate, complete

    def delta(self, s: State) -> str:
        raise NotImplementedError

    def observed(self, s: State) -> str:
        return join_chunks(s.chunks)

    def step(self, s: State, chunk: str, last: bool) -> tuple[str, str]:
        s.chunks.append(chunk or "")
        observed = self.observed(s)
        delta = self.complete(observed, s.committed) if last else self.delta(s) if observed else ""
        s.committed += delta
        return (WRITE if delta else READ), delta

    def run(self, chunks: list[str]) -> list[tuple[str, str]]:
        s = State()
        return [self.step(s, c, k == len(chunks) - 1) for k, c in enumerate(chunks)]


class WaitK(Policy):
    """STR-01, STR-04: read until ``k`` chunks with words are there, then write what the hypothesis adds."""

    def __init__(self, translate, complete, k: int = 3):
        super().__init__(translate, complete)
        self.k = k

    def delta(self, s: State) -> str:
        if sum(bool(c.strip()) for c in s.chunks) < self.k:
            return ""
        hyp = self.translate(join_chunks(s.chunks), s.committed)
        return hyp[len(s.committed) :] if hyp.startswith(s.committed) else ""


class LocalAgreement(Policy):
    """STR-02, STR-03: write what the last ``n`` hypotheses share beyond what is committed.

    Only each ``segment``-th chunk is answered; a window that isn't full yet agrees with itself, unless ``full_window``.
    """

    def __init__(self, translate, complete, n: int = 2, segment: int = 1, words: bool = False, full_window: bool = False):
        super().__init__(translate, complete)
        self.n, self.segment, self.words, self.full_window = n, segment, words, full_window

    def delta(self, s: State) -> str:
        if len(s.chunks) % self.segment:
            return ""
        s.history = [*s.history, self.translate(join_chunks(s.chunks), s.committed)][-self.n :]
        if self.full_window and len(s.history) < self.n:
            return ""
        agreed = common_prefix(s.history, self.words)
        return agreed[len(s.committed) :] if agreed.startswith(s.committed) else ""


class Consensus(Policy):
    """STR-05..07: sample futures, grow tokens on which all of them agree, commit the longest clean prefix.

    ``futures(observed)`` gives continuations; ``distribution(observed + future, committed, pending)`` {token id: p};
    ``decode(ids)`` text. With ``least_futures`` or fewer the chunk is read; fewer than ``horizon`` grown tokens are
    dropped; what isn't clean at the end is discarded. Ties fall to the smaller token id.
    """

    def __init__(self, futures, distribution, decode, complete, top_k: int = 6, top_p: float = 0.0, min_p: float = 0.0, steps: int = 12, horizon: int = 1, least_futures: int = 3):
        super().__init__(None, complete)
        self.futures, self.distribution, self.decode = futures, distribution, decode
        self.top_k, self.top_p, self.min_p, self.steps, self.horizon, self.least_futures = top_k, top_p, min_p, steps, horizon, least_futures

    def _kept(self, dist: dict[int, float]) -> set[int]:
        ranked = sorted(dist.items(), key=lambda x: (-x[1], x[0]))
        if self.top_p > 0:
            out, total = set(), 0.0
            for t, p in ranked:
                if total >= self.top_p:
                    break
                out.add(t)
                total += p
            return out
        return {t for t, p in ranked if p >= self.min_p} if self.min_p > 0 else {t for t, _ in ranked[: self.top_k]}

    def vote(self, dists: list[dict[int, float]]) -> int | None:
        shared = set.intersection(*map(self._kept, dists)) if dists else set()
        return min(shared, key=lambda t: (-sum(d.get(t, 0.0) for d in dists), t)) if shared else None

    def delta(self, s: State) -> str:
        observed = join_chunks(s.chunks)
        futures = list(dict.fromkeys(f for f in self.futures(observed) if f))
        if len(futures) <= self.least_futures:
            return ""
        pending: list[int] = []
        for _ in range(self.steps):
            dists = [self.distribution(f"{observed} {f}", s.committed, pending) for f in futures]
            if not all(dists) or (token := self.vote(dists)) is None:
                break
            pending.append(token)
        if len(pending) < self.horizon:
            return ""
        for n in range(len(pending), 0, -1):
            text = self.decode(pending[:n])
            if text and "�" not in text and (text[-1].isprintable() or text[-1].isspace()):
                return text
        return ""


def wait_k_actions(df: DataFrame, key: str, order: str, chunk: str, k: int) -> DataFrame:
    """The part of STR-01 that needs no model: READ before the k-th chunk with words and for chunks that add none, WRITE from there on."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    full = (F.length(F.trim(F.coalesce(chunk, F.lit("")))) > 0).cast("int")
    seen = F.sum(full).over(w)
    return df.withColumn("seen", seen.cast("int")).withColumn("action", F.when(F.col("seen") >= k, WRITE).otherwise(READ))


OUT = "utt_id {0}, actions array<string>, deltas array<string>, prediction string"


def run_batch(df: DataFrame, policy: Callable[[], Policy], key: str = "utt_id", chunks: str = "chunks") -> DataFrame:
    """A policy over whole utterances (key, array of chunks): each is one row, so no shuffle is needed."""
    schema = OUT.format(df.schema[key].dataType.simpleString()).replace("utt_id", key, 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = policy()
        for f in frames:
            rows = [p.run(list(c)) if c is not None else [] for c in f[chunks]]
            yield pd.DataFrame({key: f[key], "actions": [[a for a, _ in r] for r in rows], "deltas": [[d for _, d in r] for r in rows], "prediction": ["".join(d for _, d in r) for r in rows]})

    return df.select(key, chunks).mapInPandas(run, schema)


def run_grouped(df: DataFrame, policy: Callable[[], Policy], key: str, order: str, chunk: str) -> DataFrame:
    """The same over one row a chunk: chunks are gathered by key, in order."""
    rows = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, chunk))), lambda s: s[chunk]).alias("chunks"))
    return run_batch(rows, policy, key)


def streaming_processor(policy: Callable[[], Policy], key: str, order: str, chunk: str, last: str):
    """A processor for ``transformWithStateInPandas``: chunks are buffered until those before them are there, then stepped in order.

    State: the next place, the committed text, and the buffer; an utterance's state is dropped after its last chunk.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Processor(StatefulProcessor):
        def init(self, handle):
            self.handle, self.policy = handle, policy()
            self.state = handle.getValueState("state", "at long, chunks array<string>, committed string, history array<string>")
            self.waiting = handle.getMapState("waiting", "at long", "chunk string, last boolean")

        def handleInputRows(self, key_, rows, timers):  # noqa: N802
            for f in rows:
                for at, c, z in zip(f[order], f[chunk], f[last], strict=True):
                    self.waiting.updateValue((int(at),), (c, bool(z)))
            have = self.state.get() if self.state.exists() else (0, [], "", [])
            at, s = int(have[0]), State(list(have[1]), have[2], list(have[3]))
            out, done = [], False
            while self.waiting.containsKey((at,)):
                c, z = self.waiting.getValue((at,))
                self.waiting.removeKey((at,))
                out.append((key_[0], at, *self.policy.step(s, c, z)))
                at, done = at + 1, done or z
            if done:
                self.state.clear()
            else:
                self.state.update((at, s.chunks, s.committed, s.history))
            if out:
                yield pd.DataFrame(out, columns=[key, order, "action", "delta"])

        def close(self):
            pass

    return Processor()


def run_stream(df: DataFrame, policy: Callable[[], Policy], key: str, order: str, chunk: str, last: str) -> DataFrame:
    """A policy over a stream of chunks; needs the RocksDB state store."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField(key, df.schema[key].dataType), StructField(order, LongType()), StructField("action", StringType()), StructField("delta", StringType())])
    return df.select(key, order, chunk, last).groupBy(key).transformWithStateInPandas(streaming_processor(policy, key, order, chunk, last), schema, "Append", "none")


def last_chunk(df: DataFrame, key: str, order: str) -> Column:
    """A flag for the last chunk of each key of a batch table."""
    return F.lead(order).over(Window.partitionBy(key).orderBy(order)).isNull()
