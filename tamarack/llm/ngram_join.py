"""Similarity join of documents on word n-grams by a token-group matrix.

Documents with equal shingle sets form a class. Classes meet through *tokens*, contents of hash buckets of a shingle
set: two sets within the similarity bound differ in at most ``d`` shingles, which spoil at most ``d`` buckets, so their
``d + l`` first bucket contents in a common order have ``l`` in common. Then:

1. Classes with fewer than ``l`` tokens that any other class has can't be linked, nor can those of whose shingles too
   few occur in any other candidate (their coverage).
2. Similar classes are partitioned into groups: each joins the class of the largest covered share that it meets in a
   token's row, the group's leader.
3. Each group's token union is stored: a row (shingle, group), with the least and the largest class that have it. The
   overlap of a class with a group's union, itself left out, is a shuffled count over these rows. Only groups whose
   overlap and sizes allow a link are kept for a class.
4. Each class is tested against the leaders of those groups; the links make components. A class that its own leader's
   component holds needs no more than other components' groups; the other classes open all groups that they kept.
5. Opening a group takes its members in blocks, each with the union of its shingles and the rows that have them. A
   query's overlap with the block's union is bounded again, and the overlaps with all members are counted at once. One
   link for each component that a query meets is told, never all pairs.

All bounds are exact: no link can be missed but by a collision of 64-bit hashes. Hot tokens, groups and leaders are dealt
over many tasks (HOT, BLOCK, QUERIES), and a task holds one block at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import drop_staged, fold, mix, shingles, slices, small_batches, staged, tidy, utf8, words
from tamarack.llm.components import connected_components
from tamarack.llm.exact_dedup import rows_with_ids, rows_without_ids

#: Linked: OF * intersection >= LEAST * union.
LEAST, OF = 80, 100
WIDTH = 5
#: Rows of one batch with a token from which on the token's rows are dealt out by class, too.
HOT = 16
#: Shingles of a group's members that one task holds at a time, and queries that it takes.
BLOCK, QUERIES = 1 << 18, 1 << 12
_U = np.uint64


def shingle_sets(buf: np.ndarray, off: np.ndarray, seed: int = 0):
    """The sorted distinct shingle hashes of each text."""
    rows = len(off) - 1
    h, row, _ = words(fold(buf), off, seed)
    s, r = shingles(h, row, rows, WIDTH)
    at = np.searchsorted(r, np.arange(rows + 1))
    return [np.unique(s[at[k] : at[k + 1]]) for k in range(rows)]


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set: the class, and a check on it."""
    with np.errstate(over="ignore"):
        a, b = mix(mix(s + _U(3)).sum(dtype=_U).reshape(1) + _U(len(s))), mix(mix(s ^ _U(0xA5A5A5A55A5A5A5A)).sum(dtype=_U).reshape(1) + _U(len(s)))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def max_difference(n: int, other: int) -> int:
    """Most shingles in which a set of ``n`` can differ from a linked set of at most ``other``."""
    out = 0
    for total in range(n + max(1, other - 3), n + other + 1):
        least = -(-LEAST * total // (LEAST + OF))
        out = max(out, total - 2 * least)
    return out


def tokens(s: np.ndarray) -> np.ndarray:
    """Hashes of the set's selective bucket contents.

    Sizes fall in bands [2^k, 2^(k+1)); a pair meets in the band of its larger set, so a set near the end of its band
    has tokens for the next one too. Contents with more shingles come first: they are shared by chance the least. An
    empty bucket is a content as well. Linked sets share max(1, n / 50) tokens at least.
    """
    n = len(s)
    band = n.bit_length() - 1
    out = []
    with np.errstate(over="ignore"):
        for k in (band, band + 1):
            top = min((2 << k) - 1, n * OF // LEAST)
            if k > band and top < 1 << k:
                continue
            m = (2 * ((2 << k) - 1) * 3 // 2) // 9 + 1
            d = max_difference(n, top)
            where = (mix(s + _U(12345 + k)) % _U(m)).astype(np.int64)
            count = np.bincount(where, minlength=m)
            order = np.argsort(where, kind="stable")
            full = np.flatnonzero(count)
            value = np.zeros(m, _U)
            value[full] = np.add.reduceat(mix(s + _U(999))[order], np.concatenate([[0], np.cumsum(count[full])[:-1]]))
            value = mix(value + mix(np.arange(m, dtype=_U) + _U(m << 20)))
            out.append(value[np.lexsort((value, -count))[: d + max(1, n // 40)]])
    return np.concatenate(out)


def _signatures(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, n_shingles, cls, chk)."""

    def run(batches):
        for b in batches:
            buf, off, _ = utf8(b.column(1))
            n, c, k = [], [], []
            for i, j in slices(off):
                for s in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], seed):
                    n.append(len(s))
                    one, two = set_hash(s)
                    c.append(one)
                    k.append(two)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(k, pa.int64())], names=["doc_id", "n_shingles", "cls", "chk"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, cls long, chk long")


def _matrix(docs: DataFrame, seed: int) -> DataFrame:
    """(token, cls, hot): a row for each token of each class, about once a class.

    Rows of tokens that one batch has many of are ``hot``: they are dealt by token and class, and one copy, not hot, by the token.
    """

    def batch(t, c):
        t, c = np.concatenate(t), np.concatenate(c)
        _, first, inverse, count = np.unique(t, return_index=True, return_inverse=True, return_counts=True)
        hot, mark = (count >= HOT)[inverse], first[count >= HOT]
        cols = [np.concatenate([x, x[mark]]) for x in (t, c)] + [np.concatenate([hot, np.zeros(len(mark), bool)])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["token", "cls", "hot"])

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            buf, off, _ = utf8(b.column(0))
            t, c, held = [], [], 0
            for i, j in slices(off):
                for s in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], seed):
                    if not len(s) or (k := set_hash(s)[0]) in seen:
                        continue
                    if len(seen) < 1_000_000:  # copies in one task are written once; others are equal rows
                        seen.add(k)
                    v = tokens(s).view(np.int64)
                    t.append(v)
                    c.append(np.full(len(v), k))
                    held += len(v)
                if held > 1 << 17:
                    yield batch(t, c)
                    t, c, held = [], [], 0
            if t:
                yield batch(t, c)

    return docs.select("text").mapInArrow(tidy(run), "token long, cls long, hot boolean")


def _shared_rows(matrix: DataFrame) -> DataFrame:
    """The matrix rows (token, cls) of tokens that two classes or more have; a task holds one row of a token beyond its batch."""

    def run(batches):
        held = None  # the last row, and whether its token is known to be shared (and the row told)
        for b in batches:
            t, c, hot = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(t):
                continue
            known = np.zeros(len(t), bool)
            if held is not None:
                t, c, hot, known = (np.concatenate([[x], y]) for x, y in zip(held, (t, c, hot, known), strict=True))
            told = known.copy()
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])  # a class of several tasks
            at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.concatenate([at, [len(t)]]))
            shared = (np.add.reduceat(new.astype(np.int64), at) > 1) | np.logical_or.reduceat(hot | known, at)
            out = np.repeat(shared, size) & new & ~told
            held = (t[-1], c[-1], bool(hot[at[-1] :].any()), bool(shared[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (t, c)], names=["token", "cls"])

    place = F.when(F.col("hot"), F.xxhash64("token", "cls")).otherwise(F.col("token"))
    return matrix.repartition(place).sortWithinPartitions("token", "cls", "hot").mapInArrow(tidy(run), "token long, cls long")


def _sets(docs: DataFrame, seed: int) -> DataFrame:
    """(cls, n, s): the class of each text, its size and its sorted shingles."""

    def run(batches):
        for b in batches:
            buf, off, _ = utf8(b.column(0))
            for i, j in slices(off):
                got = [x for x in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], seed) if len(x)]
                if got:
                    at = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                    s = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(got).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([set_hash(x)[0] for x in got], pa.int64()), pa.array(np.diff(at).astype(np.int64)), s], names=["cls", "n", "s"])

    return docs.select("text").mapInArrow(tidy(run), "cls long, n long, s array<bigint>")


def _enough(overlap, n, other):
    """Whether an overlap of so many shingles can link sets of these sizes, or of ``other`` at least."""
    return (LEAST + OF) * overlap >= LEAST * (n + F.greatest(other, F.ceil(n * LEAST / OF)))


def _leaders(rows: DataFrame) -> DataFrame:
    """(cls, grp): the class of the largest covered share that each class meets in a token's row, from (token, cls, share)."""
    best = rows.groupBy("token").agg(F.max(F.struct("share", "cls")).alias("best"))
    return rows.select("token", "cls").join(best, "token").groupBy("cls").agg(F.max("best").alias("best")).select("cls", F.col("best.cls").alias("grp"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of linked classes."""
    both = pairs.join(sets.select(F.col("cls").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("cls").alias("v"), F.col("s").alias("b")), "v")
    same = F.size(F.array_intersect("a", "b"))
    return both.filter(OF * same >= LEAST * (F.size("a") + F.size("b") - same)).select("u", "v")


class _Block:
    """Members of a group with the union of their shingles."""

    def __init__(self, cls, comp, weight, sets):
        self.cls, self.comp, self.weight = cls, comp, weight
        self.n = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        self.union, where, self.count = np.unique(every, return_inverse=True, return_counts=True)
        self.holder = np.repeat(np.arange(len(sets)), self.n)[np.argsort(where, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(self.count)[:-1]])
        self.own = {c: k for k, c in enumerate(cls.tolist())}

    def links(self, cls: int, s: np.ndarray) -> np.ndarray:
        """Rows of the members that are linked with the class."""
        at = np.minimum(np.searchsorted(self.union, s), len(self.union) - 1)
        at = at[self.union[at] == s]
        n, own = len(s), self.own.get(cls)
        small = max(int(self.n.min()), -(-n * LEAST // OF))
        if (LEAST + OF) * int((self.count[at] > (own is not None)).sum()) < LEAST * (n + small):
            return np.zeros(0, np.int64)
        size = self.count[at]
        rows = np.repeat(self.start[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        same = np.bincount(self.holder[rows], minlength=len(self.n))
        ok = OF * same >= LEAST * (n + self.n - same)
        if own is not None:
            ok[own] = False
        return np.flatnonzero(ok)


def _opened(rows: DataFrame, every: bool) -> DataFrame:
    """(u, v, weight): links of queries to members of the groups that they open, one for each component and block, and the documents that the links lead to.

    ``rows``: (grp, block, part, query, cls, comp, weight, s), a block's members before its queries. With ``every`` the links inside a
    component are counted, too.
    """

    def run(batches):
        key, held, block = None, [], None
        for b in batches:
            num = [b.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            lists = b.column(7)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = []
            for k in range(b.num_rows):
                if (now := (num[0][k], num[1][k], num[2][k])) != key:
                    key, held, block = now, [], None
                s = values[at[k] : at[k + 1]]
                if not num[3][k]:
                    held.append((num[4][k], num[5][k], num[6][k], s.copy()))
                    continue
                if block is None and held:
                    block = _Block(*(np.array(x) for x in list(zip(*held, strict=True))[:3]), [x[3] for x in held])
                    held = []
                if block is None:
                    continue
                found = block.links(int(num[4][k]), s)
                if not every:
                    found = found[block.comp[found] != num[5][k]]
                if len(found):
                    comps, first, inverse = np.unique(block.comp[found], return_index=True, return_inverse=True)
                    total = np.bincount(inverse, weights=block.weight[found]).astype(np.int64)
                    out += [(num[4][k], block.cls[found[f]], w) for f, w in zip(first, total, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*out, strict=True)], names=["u", "v", "weight"])

    dealt = rows.repartition("grp", "block", "part").sortWithinPartitions("grp", "block", "part", "query", "cls")
    return dealt.select("grp", "block", "part", "query", "cls", "comp", "weight", "s").mapInArrow(tidy(run), "u long, v long, weight long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), and n_links with ``count_links``: the component of every document under links between similar sets.

    component_id is the smallest id that links reach. n_links counts the other documents that a document is linked
    with; it takes every class as a query of the groups it may be linked into, where components alone need those only
    that their groups' leaders don't settle. A text without words, or null, has an empty set: it is a component of its
    own, also beside other empty ones. Fewer than WIDTH words are one shingle. Rows that repeat an id are alike if their
    texts are, and each counts; of an id with several texts each row has the component of its own text. A row with a
    null id has the n_links of its text but no component, and gives no links. An empty table gives an empty result;
    further columns of ``docs`` aren't read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for seed in range(4):
        signed = staged(_signatures(docs, seed), "signatures")
        known = signed.filter("n_shingles > 0 and doc_id is not null")
        found = known.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.count("*").alias("weight"), F.min("chk").alias("lo"), F.max("chk").alias("hi"))
        classes = staged(found, "classes")
        if classes.filter("lo <> hi").isEmpty():
            break
    else:
        raise RuntimeError("set hashes collide under each seed")
    shared = staged(_shared_rows(_matrix(docs, seed)), "matrix")
    least_tokens = F.greatest(F.lit(1), F.floor(F.col("n") / 50))
    met = shared.groupBy("cls").count().join(classes.select("cls", "doc_id", "n", "weight"), "cls").filter(F.col("count") >= least_tokens)
    wanted = staged(met.select("cls", "doc_id", "weight"), "wanted")
    # An id may have several texts: of the sets of its rows only a wanted class's own is taken, once.
    sets = _sets(rows_with_ids(docs, wanted.select("doc_id").distinct(), "doc_id"), seed).dropDuplicates(["cls"])
    sets = staged(sets.join(wanted.select("cls", "weight"), "cls"), "sets")
    every = sets.select(F.explode("s").alias("t"), "cls")
    twice = every.groupBy("t").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("t")
    covered = staged(every.join(twice, "t"), "covered")
    cover = covered.groupBy("cls").count().join(sets.select("cls", "n", "weight"), "cls")
    cover = cover.filter(_enough(F.col("count"), F.col("n"), F.lit(1))).select("cls", "n", "weight", (F.col("count") / F.col("n")).alias("share"))
    cover = staged(cover, "cover")
    home = _leaders(shared.select("token", "cls").join(cover.select("cls", "share"), "cls"))
    home = staged(cover.join(home, "cls").select("cls", "grp", "n", "weight"), "home")
    group = staged(home.groupBy("grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("size")), "groups")
    union = staged(covered.join(home.select("cls", "grp"), "cls").groupBy("t", "grp").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")), "unions")
    # The matrix of prefix tokens tells which groups a class may meet at all, so that overlaps are counted for these alone.
    prefix = staged(shared.select("token", "cls").join(home.select("cls", F.col("grp").alias("own"), "n"), "cls"), "prefix")
    drop_staged(shared)
    held = prefix.groupBy("token", F.col("own").alias("grp")).agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    others = (F.col("grp") != F.col("own")) | (F.col("lo") != F.col("hi"))
    meets = prefix.join(held, "token").filter(others).groupBy("cls", "own", "n", "grp").count().filter(F.col("count") >= least_tokens)
    meets = meets.drop("count").join(group, "grp").filter((OF * F.col("most") >= LEAST * F.col("n")) & (OF * F.col("n") >= LEAST * F.col("least")))
    meets = staged(meets, "meets")
    overlap = covered.join(meets.select("cls", "own", "grp"), "cls").join(union, ["t", "grp"]).filter(others).groupBy("cls", "grp").count()
    routes = meets.join(overlap, ["cls", "grp"]).filter(_enough(F.col("count"), F.col("n"), F.col("least")))
    routes = staged(routes.select("cls", "own", "grp", "size", "total"), "routes")
    drop_staged(covered)
    drop_staged(union)
    stars = staged(_linked(routes.filter("cls <> grp").select(F.col("cls").alias("u"), F.col("grp").alias("v")), sets.select("cls", "s")), "stars")
    settled = staged(connected_components(stars), "settled")

    def component(df, of, name):
        return df.join(settled.select(F.col("node").alias(of), F.col("component").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))

    placed = staged(component(home.join(routes.select("cls").distinct(), "cls"), "cls", "comp"), "placed")
    if count_links:
        queries = routes.join(placed.select("cls", "comp", "weight"), "cls")
    else:
        sizes = group.select(F.col("grp").alias("own"), F.col("size").alias("own_size"))
        queries = component(component(routes.join(placed.select("cls", "comp", "weight"), "cls"), "own", "own_comp"), "grp", "grp_comp").join(sizes, "own")
        smaller = F.struct("own_size", "own") < F.struct("size", "grp")
        queries = queries.filter((F.col("comp") != F.col("own_comp")) | ((F.col("comp") != F.col("grp_comp")) & smaller))
    queries = staged(queries.select("cls", "grp", "comp", "weight", "total"), "queries")
    plan = queries.groupBy("grp").agg(F.ceil(F.max("total") / BLOCK).alias("blocks"), F.ceil(F.count("*") / QUERIES).alias("parts"))
    spread = lambda of, n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(of)
    dealt = lambda of, n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n)).alias(of)
    plan = staged(plan, "plan")
    inside = placed.join(plan, "grp").select("grp", dealt("block", "blocks", 1), spread("part", "parts"), F.lit(False).alias("query"), "cls", "comp", "weight")
    asked = queries.join(plan, "grp").select("grp", spread("block", "blocks"), dealt("part", "parts", 2), F.lit(True).alias("query"), "cls", "comp", "weight")
    opened = staged(_opened(inside.unionByName(asked).join(sets.select("cls", "s"), "cls"), count_links), "opened")
    links = opened.select("u", "v").unionByName(settled.select(F.col("node").alias("u"), F.col("component").alias("v")))
    parts = connected_components(links)
    least = parts.join(classes, parts["node"] == classes["cls"]).groupBy("component").agg(F.min("doc_id").alias("least"))
    placed = classes.select("cls", F.col("doc_id").alias("own"), "weight").join(parts.withColumnRenamed("node", "cls"), "cls", "left").join(least, "component", "left")
    degree = opened.groupBy(F.col("u").alias("cls")).agg(F.sum("weight").alias("others"))
    placed = placed.join(degree, "cls", "left").select("cls", F.coalesce("least", "own").alias("component_id"), "weight", F.coalesce("others", F.lit(0).cast("long")).alias("others"))
    full, empty = signed.filter("n_shingles > 0"), signed.filter("n_shingles = 0")
    number = F.coalesce(F.col("weight") - F.when(F.col("doc_id").isNull(), 0).otherwise(1) + F.col("others"), F.lit(0)).cast("long").alias("n_links")
    out = full.join(placed, "cls", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), number)
    out = out.unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    return out if count_links else out.drop("n_links")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those of each component other than its smallest id; rows with a null id stay."""
    found = similar_components(docs, id_col, text_col)
    gone = staged(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "dropped")
    return rows_without_ids(docs, gone, id_col)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), count_links=True)
