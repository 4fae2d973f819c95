"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every normalised text into a blocked Bloom filter whose bits are set where *two or more* rows fell.
Pass two sends only the rows whose bits are all set through a shuffle, where an exact digest groups them; every other
row is certain to be alone and passes straight through. A false positive costs a shuffled row, never a wrong result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import LOWER, UPPER, free_name

#: Bits of one block: what ``bitmap_construct_agg`` holds.
BLOCK_BITS = 32768


def normalised(text: Column) -> Column:
    """Null reads as empty; only A-Z are lower-cased."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (F.call_function("mod", F.floor(byte / F.pow(F.lit(2), at.bitwiseAND(F.lit(7)))), F.lit(2))) == 1


def bloom_blocks(rows: int, bits_per_row: int, max_bits: int) -> int:
    """Blocks of a filter for so many rows: a power of two, of ``max_bits`` at most."""
    return 1 << math.floor(math.log2(max(1, min(max_bits, rows * bits_per_row) // BLOCK_BITS)))


def bloom_filter(probes: DataFrame, probe: str, blocks: int, least: int = 2) -> DataFrame:
    """(block, bits) with a bit set where at least ``least`` rows of ``probes`` fell; at most ``blocks`` rows of 4 KB."""
    p = F.col(probe)
    cells = probes.select(F.pmod(p, F.lit(blocks)).alias("block"), F.explode(F.array(*_places(p))).alias("bit")).groupBy("block", "bit").agg(F.count("*").alias("n"))
    return cells.filter(F.col("n") >= least).groupBy("block").agg(F.call_function("bitmap_construct_agg", F.col("bit").cast("bigint")).alias("bits"))


def _places(p: Column) -> list[Column]:
    again = F.xxhash64(p, F.lit(17))
    return [again.bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int"), F.shiftrightunsigned(again, 20).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")]


def split_by_ids(docs: DataFrame, ids: DataFrame, id_col: str, max_bits: int = 1 << 28) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows whose id may be among ``ids`` (one column of that name, distinct), and rows whose id certainly isn't.

    A broadcast Bloom filter of the ids tells them apart, so neither part shuffles; null ids are in the second.
    """
    probe, block, bits, maybe = (free_name(docs.columns, f"__{x}") for x in ("probe", "block", "bits", "maybe"))
    blocks = bloom_blocks(ids.count(), 32, max_bits)
    filt = bloom_filter(ids.select(F.xxhash64(F.col(id_col).cast("string")).alias("p")), "p", blocks, 1).select(F.col("block").alias(block), F.col("bits").alias(bits))
    one, two = (_bit(F.col(bits), at) for at in _places(F.col(probe)))
    hit = F.col(id_col).isNotNull() & F.coalesce(one & two, F.lit(False))
    flagged = docs.withColumn(probe, F.xxhash64(F.col(id_col).cast("string"))).withColumn(block, F.pmod(F.col(probe), F.lit(blocks))).join(F.broadcast(filt), block, "left").withColumn(maybe, hit)
    return flagged.filter(F.col(maybe)).select(*docs.columns), flagged.filter(~F.col(maybe)).select(*docs.columns)


def rows_with_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids``: only rows that pass the Bloom filter take part in the exact join."""
    ids = ids.select(F.col(id_col).alias(id_col))
    return split_by_ids(docs, ids, id_col)[0].join(ids, id_col, "left_semi").select(*docs.columns)


def rows_without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id isn't among ``ids``; those that the Bloom filter turns away pass straight through."""
    ids = ids.select(F.col(id_col).alias(id_col))
    maybe, rest = split_by_ids(docs, ids, id_col)
    return rest.unionByName(maybe.join(ids, id_col, "left_anti").select(*docs.columns))


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 32, max_bits: int = 1 << 28) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; such columns that ``docs`` has are replaced.

    Of rows with equal normalised text the one with the largest id stays. Null text equals empty text. Rows that repeat
    an id and its text are all marked alike, and each counts in group_size; a null id never outranks another. An empty
    table gives an empty result. The filter is broadcast: it has ``bits_per_row`` bits a row, but never over
    ``max_bits`` (32 MB); past that more rows take the shuffle, and the result stays exact.
    """
    outs = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in outs and c not in (id_col, text_col)])
    block, bits, probe, sha = (free_name(docs.columns, f"__{x}") for x in ("block", "bits", "probe", "sha"))
    blocks = bloom_blocks(docs.count(), bits_per_row, max_bits)
    # lower() folds more than A-Z, so equal normalised texts still have equal probes; it is far cheaper than the exact form.
    probed = docs.withColumn(probe, F.xxhash64(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    filt = bloom_filter(probed.select(probe), probe, blocks).select(F.col("block").alias(block), F.col("bits").alias(bits))
    one, two = (_bit(F.col(bits), at) for at in _places(F.col(probe)))
    flagged = probed.withColumn(block, F.pmod(F.col(probe), F.lit(blocks))).join(F.broadcast(filt), block, "left")
    maybe = F.coalesce(one & two, F.lit(False))
    exact = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    alone = flagged.filter(~maybe).select(*docs.columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), exact.alias("text_sha256"))
    maybe_rows = flagged.filter(maybe).select(*docs.columns, exact.alias(sha))
    groups = maybe_rows.groupBy(F.col(sha).alias(sha)).agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size"))
    # A plain equi-join: where a group of copies is hot, adaptive execution splits its side of the join.
    met = maybe_rows.join(groups, sha).select(*docs.columns, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.col(sha).alias("text_sha256"))
    return alone.unionByName(met)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that :func:`mark_exact_duplicates` keeps, with the columns of ``docs``."""
    return mark_exact_duplicates(docs, id_col, text_col).filter("kept").select(*docs.columns)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mark_exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op10_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
}
