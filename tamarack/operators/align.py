"""Matching of text chunks to timed words, and time windows (JOI-18..26, WIN-01..04, JOI-32, JOI-34)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions.text import normalize, word_tokens


def greedy_positions(tokens: Column, words: Column, start: Column | int = 0) -> Column:
    """JOI-18, JOI-22: the 1-based place of each token's first match in ``words`` after the one before it; 0 where none follows."""
    start = F.lit(start) if isinstance(start, int) else start
    init = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        hit = F.array_position(F.slice(words, (s["at"] + 1).cast("int"), F.size(words)), t)
        found = F.when(hit > 0, s["at"] + hit).otherwise(F.lit(0)).cast("bigint")
        return F.struct(F.when(found > 0, found).otherwise(s["at"]).alias("at"), F.concat(s["out"], F.array(found)).alias("out"))

    return F.aggregate(tokens, init, step, lambda s: s["out"])


def naive_positions(tokens: Column, words: Column) -> Column:
    """JOI-20: the first occurrence of each token anywhere."""
    return F.transform(tokens, lambda t: F.array_position(words, t))


def chunk_positions(chunks: Column, words: Column, reset: bool = False) -> Column:
    """Matched places of each chunk's tokens: one cursor over all chunks, or one for each (JOI-21, JOI-35) if ``reset``."""
    if reset:
        return F.transform(chunks, lambda c: greedy_positions(word_tokens(c), words))
    init = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        got = greedy_positions(word_tokens(c), words, s["at"])
        return F.struct(F.greatest(s["at"], F.coalesce(F.array_max(got), F.lit(0))).cast("bigint").alias("at"), F.concat(s["out"], F.array(got)).alias("out"))

    return F.aggregate(chunks, init, step, lambda s: s["out"])


def chunk_intervals(chunks: Column, words: Column, reset: bool = False) -> Column:
    """array<struct(start, end)> of chunks over array<struct(word, start, end)>, both normalised; nulls for a chunk without a match."""
    places = chunk_positions(chunks, F.transform(words, lambda w: normalize(w["word"])), reset)

    def interval(p: Column) -> Column:
        hit = F.filter(p, lambda x: x > 0)
        return F.struct(F.get(words, (F.array_min(hit) - 1).cast("int"))["start"].alias("start"), F.get(words, (F.array_max(hit) - 1).cast("int"))["end"].alias("end"))

    return F.transform(places, interval)


def strict_match(chunks: Column, words: Column) -> Column:
    """JOI-19: the number, from 0, of the first chunk with an unmatched token; null if all match."""
    bad = F.transform(chunk_positions(chunks, words), lambda p: F.exists(p, lambda x: x == 0))
    return F.nullif(F.array_position(bad, True), F.lit(0)) - 1


def window_of_ms(end_ms: Column, window_ms: int) -> Column:
    """WIN-01..03 on whole milliseconds: the first window whose end isn't before ``end_ms``."""
    return F.greatest(F.lit(0), F.ceil(end_ms / F.lit(window_ms)) - 1).cast("int")


def window_of_seconds(end: Column, seconds: float) -> Column:
    """The same on floating seconds, by the literal comparison end <= (k + 1) * seconds."""
    base = F.greatest(F.lit(0), F.floor(end / F.lit(seconds)) - 1)
    return F.when(end <= (base + 1) * F.lit(seconds), base).when(end <= (base + 2) * F.lit(seconds), base + 1).otherwise(base + 2).cast("int")


def emission_windows(intervals: Column, duration: Column, seconds: float = 0.96, leftovers: str = "append") -> Column:
    """WIN-01, WIN-02: for each window, the chunks (from 0) emitted in it, in order.

    A chunk is emitted in the first window whose end isn't before its own. Chunks that no window takes, and those
    without an interval, go to the last window (``append``) or nowhere (``drop``). Without any interval there is one
    empty window.
    """
    ends = F.transform(intervals, lambda i: i["end"])
    last = F.coalesce(F.array_max(ends), F.lit(0.0))
    total = F.ceil(F.greatest(F.coalesce(duration, last), last) / F.lit(seconds) - F.lit(1e-6)).cast("int")
    at = F.transform(ends, lambda e: F.when(e.isNotNull(), window_of_seconds(e, seconds)))
    index = F.sequence(F.lit(0), F.greatest(F.size(ends) - 1, F.lit(0)))

    def held(k: Column) -> Column:
        own = F.filter(index, lambda i: F.get(at, i) == k)
        if leftovers != "append":
            return own
        rest = F.filter(index, lambda i: (i < F.size(ends)) & (F.get(at, i).isNull() | (F.get(at, i) >= total)))
        return F.when(k == total - 1, F.concat(own, rest)).otherwise(own)

    none = F.array().cast("array<int>")
    return F.when(~F.exists(ends, lambda e: e.isNotNull()), F.array(none)).when(total <= 0, F.array().cast("array<array<int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0))), held))


def window_text(windows: Column, segments: Column, sep: str) -> Column:
    """AGG-08: the text of each window's chunks."""
    return F.transform(windows, lambda w: F.array_join(F.filter(F.transform(w, lambda i: F.get(segments, i)), lambda s: s != ""), sep))


def tumbling(events: DataFrame, key: str, ms: str, window_ms: int, value: Column, name: str = "n", dense: bool = True) -> DataFrame:
    """Rows to windows of ``window_ms`` by key: (key, window, name), with empty windows up to the last if ``dense``.

    One aggregation on (key, window); the windows in between come from each key's largest, not from a join.
    """
    agg = events.groupBy(key, window_of_ms(F.col(ms), window_ms).alias("window")).agg(value.alias(name))
    if not dense:
        return agg
    last = F.lag("window", 1, -1).over(Window.partitionBy(key).orderBy("window"))
    gaps = agg.withColumn("from", last + 1).select(key, F.explode(F.sequence(F.col("from"), F.col("window"))).alias("w"), F.col("window").alias("full"), F.col(name))
    return gaps.select(key, F.col("w").alias("window"), F.when(F.col("w") == F.col("full"), F.col(name)).otherwise(F.lit(0)).alias(name))


def overlapping_seconds(words: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """JOI-23, JOI-24: each word in each second that it overlaps, by an exploded range rather than a range join."""
    first, last = F.floor(start).cast("int"), F.greatest(F.floor(start), F.ceil(end) - 1).cast("int")
    return words.withColumn("second", F.explode(F.sequence(first, last)))


def sentence_of_chunk(chunks: DataFrame, sentences: DataFrame, key: str, order: str, words: str, end: str) -> DataFrame:
    """JOI-26: the sentence of each chunk: the first whose cumulated words reach the chunk's, else the last.

    Sorted by cumulated words, one window finds it: no range join.
    """
    run = F.sum(words).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    a = chunks.select(key, F.col(order).alias("chunk"), run.alias("x"), F.lit(None).cast("int").alias("s"), F.lit(0).alias("kind"))
    b = sentences.select(key, F.lit(None).cast("long").alias("chunk"), F.col(end).alias("x"), F.col("sentence").cast("int").alias("s"), F.lit(1).alias("kind"))
    after = Window.partitionBy(key).orderBy(F.col("x").desc(), F.col("kind").desc(), F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(key)
    both = a.withColumn("chunk", F.col("chunk").cast("long")).unionByName(b)
    return both.withColumn("sentence", F.coalesce(F.last("s", True).over(after), F.max("s").over(every))).filter("kind = 0").select(key, F.col("chunk").alias(order), "sentence")


def first_difference(a: Column, b: Column, around: int = 5) -> Column:
    """JOI-32: struct(equal, at, left, right): the first place (from 0) where arrays differ, with what stands around it."""
    n = F.least(F.size(a), F.size(b))
    bad = F.array_position(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ~F.get(a, i).eqNullSafe(F.get(b, i))), True)
    at = F.when(bad > 0, bad - 1).when(F.size(a) != F.size(b), n).cast("int")

    def near(x: Column) -> Column:
        return F.slice(x, F.greatest(F.lit(1), at + 1 - around), F.lit(2 * around + 1))

    return F.struct(at.isNull().alias("equal"), at.alias("at"), F.when(at.isNotNull(), near(a)).alias("left"), F.when(at.isNotNull(), near(b)).alias("right"))
