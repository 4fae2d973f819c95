"""Segment arrays: unpivoting levels, merging short chunks, spans, punctuation repair (WIN-09..14, WIN-20..22, SCL-16..19, FLT-05..07, FLT-29, AGG-09..12)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions import text as T

LEVELS = ("low", "medium", "high", "offline")


def unpivot_levels(df: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """FLT-29: one row a level that is present: ``keep``, latency, segs (the level's struct)."""
    entries = F.array(*[F.struct(F.lit(level).alias("latency"), F.col(c).alias("segs")) for level, c in columns.items()])
    return df.select(*keep, F.inline(entries)).filter("segs is not null")


def level_reasons(en: Column, zh: Column, one_word_ok: bool = True, blanks_ok: bool = True) -> Column:
    """FLT-05, FLT-06: why a level's arrays aren't usable; empty if they are."""
    def at(test):
        return F.exists(F.coalesce(en, F.array().cast("array<string>")), test) | F.exists(F.coalesce(zh, F.array().cast("array<string>")), test)

    tests = [F.when(en.isNull() | zh.isNull(), "missing"), F.when((F.size(en) == 0) | (F.size(zh) == 0), "empty"), F.when(F.size(en) != F.size(zh), "length_mismatch"), F.when(at(lambda s: s.isNull()), "not_text")]
    if not blanks_ok:
        tests.append(F.when(at(lambda s: T.strip(s) == ""), "blank_chunk"))
    if not one_word_ok:
        tests.append(F.when((F.size(en) > 1) & F.exists(en, T.one_word), "one_word_chunk"))
    return F.array_compact(F.array(*tests))


def merge_one_word(en: Column, zh: Column, forward: bool = False) -> Column:
    """WIN-20 (backward) and WIN-21 (``forward``): struct(en, zh) with one-word chunks merged into the chunk before.

    The first chunk stays; with ``forward`` a one-word first chunk takes the second in instead. Source parts join with
    a space, target parts without. Arrays of different lengths give nulls in ``forward`` form and stay as they are else.
    """
    pairs = F.zip_with(en, zh, lambda e, z: F.struct(T.blank(e).alias("e"), T.blank(z).alias("z"), (T.one_word(e) if forward else T.one_word_stripped(e)).alias("w")))

    def begins(a: Column, i: Column) -> Column:
        led = (i == 1) & F.get(a, 0)["w"] if forward else F.lit(False)
        return (i == 0) | ~(F.get(a, i)["w"] | led)

    def glue(part: Column) -> Column:
        e = F.array_join(F.transform(part, lambda p: p["e"]), " ")
        return F.struct((F.when(F.size(part) > 1, T.collapse(e)).otherwise(e) if forward else e).alias("e"), F.array_join(F.transform(part, lambda p: p["z"]), "").alias("z"))

    def grouped(a: Column) -> Column:  # where groups begin, then each cut out once
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), lambda i: (i < F.size(a)) & begins(a, i))
        return F.get(F.transform(F.array(starts), lambda s: F.transform(s, lambda at, k: glue(F.slice(a, at + 1, F.coalesce(F.get(s, k + 1), F.size(a)) - at)))), 0)

    done = F.get(F.transform(F.array(pairs), grouped), 0)
    same = F.size(en) == F.size(zh)
    other = F.struct(F.when(F.lit(not forward), en).alias("en"), F.when(F.lit(not forward), zh).alias("zh"))
    return F.when(same, F.struct(F.transform(done, lambda p: p["e"]).alias("en"), F.transform(done, lambda p: p["z"]).alias("zh"))).otherwise(other)


def regroup(a: Column, k: Column | int, sep: str = "", skip_blank: bool = False) -> Column:
    """WIN-09: each ``k`` elements joined."""
    k = F.lit(k) if isinstance(k, int) else k
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / k) - 1, F.lit(0)).cast("int")), lambda i: F.slice(a, (i * k + 1).cast("int"), k.cast("int")))
    return F.when(F.size(a) == 0, F.array().cast("array<string>")).otherwise(F.transform(parts, lambda p: F.array_join(F.filter(p, lambda s: s != "") if skip_blank else p, sep)))


def multiplier(key: Column, low: Column | int, high: Column | int, seed: int = 42) -> Column:
    """WIN-10, WIN-11: a number in low..high that the key and the seed fix."""
    low, high = (F.lit(v) if isinstance(v, int) else v for v in (low, high))
    return (F.pmod(F.xxhash64(key, F.lit(seed)), high - low + 1) + low).cast("int")


def level_multiplier(latency: Column, key: Column, seed: int = 42) -> Column:
    """WIN-11: 1 for low, 2 for medium, 3..12 for high."""
    return F.when(latency == "low", 1).when(latency == "medium", 2).otherwise(multiplier(key, 3, 12, seed))


def spans_valid(spans: Column, total: Column) -> Column:
    """WIN-14: spans follow one another, none runs backwards or over ``total``."""
    end = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda s, p: F.struct(p["e"].cast("int").alias("at"), (s["ok"] & (p["s"] >= s["at"]) & (p["e"] >= p["s"]) & (p["e"] <= total)).alias("ok")))
    return end["ok"]


def concat_sentences(df: DataFrame, key: str, order: str, segs: list[str], ok: str) -> DataFrame:
    """AGG-09..11: sentences' arrays concatenated in order, with [s, e) spans; an utterance with a failed sentence is an error row."""
    n = F.size(segs[0])
    end = F.sum(n).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("__e", end).withColumn("__s", F.col("__e") - n)
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "__s", "__e", *segs))).alias("r"), F.bool_and(ok).alias("ok"))
    flat = [F.when(F.col("ok"), F.flatten(F.col(f"r.{s}"))).alias(s) for s in segs]
    spans = F.when(F.col("ok"), F.transform("r", lambda r: F.struct(r["__s"].cast("int").alias("s"), r["__e"].cast("int").alias("e")))).alias("spans")
    return got.select(key, *flat, spans, F.when(~F.col("ok"), "sentence_failed").alias("error"))


def offline_pairs(pairs: Column) -> Column:
    """AGG-12, SCL-80: struct(en, zh) of the pairs that aren't wholly empty."""
    kept = F.filter(pairs, lambda p: (T.strip(T.blank(p["en"])) != "") | (T.strip(T.blank(p["zh"])) != ""))
    return F.struct(F.transform(kept, lambda p: T.blank(p["en"])).alias("en"), F.transform(kept, lambda p: T.blank(p["zh"])).alias("zh"))


def sync_target_punct(en: Column, zh: Column, insert: bool = False) -> Column:
    """SCL-16: target segments whose end marks follow the source's.

    ASCII marks at their ends become full width; then, from left to right, a segment without a mark takes the next
    one's leading mark if the source segment ends in a mark of that class, or, with ``insert``, the source's own in
    full width. Arrays of different lengths stay as they are.
    """
    en_marks, zh_marks = T.EN_SENT + T.EN_CLAUSE + T.EN_COLON, T.ZH_SENT + T.ZH_CLAUSE + T.ZH_COLON
    start = F.transform(zh, lambda z: T.full_width_tail(T.blank(z)))

    def step(out: Column, i: Column) -> Column:
        cur, nxt = F.get(out, i), F.get(out, i + 1)
        mark = T.trailing_punct(F.get(en, i), en_marks)
        head = T.leading_punct(nxt, zh_marks)
        open_ = (mark != "") & (T.blank(cur) != "") & (T.trailing_punct(cur, zh_marks) == "")
        move = open_ & (head != "") & (T.punct_bucket(head) == T.punct_bucket(mark))
        put = F.when(move, head).when(open_ & F.lit(insert), F.translate(mark, ".?!,;:", "。？！，；：")).otherwise("")
        return F.transform(out, lambda s, k: F.when((k == i) & (put != ""), T.insert_before_closers(s, put)).when((k == i + 1) & move, F.regexp_replace(s, f"^({T.WS}*).", "$1")).otherwise(s))

    done = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(zh) - 1, F.lit(0))), start, step)
    return F.when(F.size(en) == F.size(zh), done).otherwise(zh)


_WORD = re.compile(r"[a-z0-9']+", re.I)


def restore_segments(segments: list[str] | None, manifest: str | None, case_sensitive: bool = True) -> list[str] | None:
    """SCL-17..19: segments cut anew from the manifest where their words are the manifest's; null if they aren't.

    Words are compared without case. Empty segments keep their places. If the joined segments already equal the
    manifest (in case too, unless ``case_sensitive`` is off) they come back as they are.
    """
    if segments is None or manifest is None:
        return None
    words = [m for m in _WORD.finditer(manifest)]
    counts = [len(_WORD.findall(s or "")) for s in segments]
    own = [w.lower() for s in segments for w in _WORD.findall(s or "")]
    if own != [m[0].lower() for m in words]:
        return None
    joined = " ".join(" ".join(s.split()) for s in segments if s and s.strip())
    plain = " ".join(manifest.split())
    if joined == plain or (not case_sensitive and joined.lower() == plain.lower()):
        return list(segments)
    out, at, begin, left = [], 0, 0, sum(c > 0 for c in counts)
    for s, n in zip(segments, counts, strict=True):
        if not n:
            out.append("" if not (s or "").strip() else s)
            continue
        at, left = at + n, left - 1
        end = len(manifest) if not left else words[at].start()
        while left and end > words[at - 1].end() and manifest[end - 1] in "\"'([{“‘":
            end -= 1  # an opening mark belongs to the word after it
        out.append(" ".join(manifest[begin:end].split()))
        begin = end
    return out


def restore_punctuation(segments: Column, manifest: Column, case_sensitive: bool = True) -> Column:
    """:func:`restore_segments` as an Arrow function."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([restore_segments(None if a is None else list(a), b, case_sensitive) for a, b in zip(s, m, strict=True)], dtype=object)

    return run(segments, manifest)


def without_errors(df: DataFrame, error: str = "error") -> DataFrame:
    """FLT-07."""
    return df.filter(F.col(error).isNull())


def pair_texts(pairs: Column) -> Column:
    """AGG-38: struct(en, zh): the trimmed parts of the pairs that aren't empty, joined; null without any."""
    kept = F.filter(F.transform(pairs, lambda p: F.struct(T.strip(T.blank(p["en"])).alias("en"), T.strip(T.blank(p["zh"])).alias("zh"))), lambda p: (p["en"] != "") | (p["zh"] != ""))
    return F.when(F.size(kept) > 0, F.struct(F.array_join(F.transform(kept, lambda p: p["en"]), " ").alias("en"), F.array_join(F.transform(kept, lambda p: p["zh"]), "").alias("zh")))


def first_level(*levels: Column) -> Column:
    """AGG-39, FLT-30: struct(en, zh) of the first of several structs of arrays that has source parts; the order of preference is the caller's."""
    def joined(level: Column) -> Column:
        return F.struct(F.array_join(F.transform(level["en"], T.strip), " ").alias("en"), F.array_join(F.transform(level["zh"], T.strip), "").alias("zh"))

    return F.coalesce(*[F.when((F.size(level["en"]) > 0) & level["zh"].isNotNull(), joined(level)) for level in levels])


def all_target(*levels: Column) -> Column:
    """AGG-40: the target parts of all levels joined; a text in three levels stands there three times."""
    return F.concat(*[T.blank(F.array_join(level["zh"], "")) for level in levels])


def local_source(full: Column, observed: Column, start: Column) -> Column:
    """WIN-24: struct(full, observed) from the sentence's first word on."""
    words = T.tokens(full)
    first = F.greatest(F.lit(0), F.least(start, F.size(words)))
    seen = F.least(F.size(T.tokens(observed)), F.size(words))
    return F.struct(F.array_join(F.slice(words, first + 1, F.size(words)), " ").alias("full"), F.array_join(F.slice(words, first + 1, F.greatest(seen - first, F.lit(0))), " ").alias("observed"))
