"""Corpus operators on a small table with nulls, empty and very long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import defaultdict
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tamarack.llm import common, components, decontaminate, exact_dedup, htmltext, langid, line_dedup, ngram_join, packing, quality, sharding, warc

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, block int, kept string"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(120)]
    texts = [None, "", " \n\t ", "one", "One", "two words", "ÀB c", "àB c"]
    for _ in range(25):  # near copies, from light edits to heavy ones
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base).upper(), "  ".join(base), " ".join(word() for _ in range(20_000)), "a\nb\nc\nd", "x\na\nb\nc\nd", "a\nb\nc", "\n\n\n\n", "q\nq\nq\nq\nq"]
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(20)]
    return [(3 * i, t, "en" if i % 2 else "de", i, "x") for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty, spark):
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[(t or "").translate(UP)].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    for bits in (1 << 28, 1):  # a filter that lets all pass, too
        got = exact_dedup.mark_exact_duplicates(docs, max_bits=bits)
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()} == want
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {max(g) for g in groups.values()}
    assert exact_dedup.mark_exact_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "a", "", 0, ""), (1, "a", "", 0, ""), (None, "a", "", 0, "")], SCHEMA)
    assert sorted((r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.mark_exact_duplicates(twice).collect()) == [(1, 3, False), (1, 3, True), (1, 3, True)]


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_ngram_join(docs, empty, monkeypatch):
    sets = {r[0]: shingle_set(r[1]) for r in ROWS}
    want = brute_components(ROWS)
    links = {i: sum(1 for j, y in sets.items() if j != i and x and y and 100 * len(x & y) >= 80 * len(x | y)) for i, x in sets.items()}
    got = ngram_join.similar_components(docs, count_links=True).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert {r["doc_id"]: r["n_links"] for r in got} == links
    assert len({c for _, c in want.values()}) < len(ROWS)
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}
    assert ngram_join.similar_components(empty).count() == 0
    for name, value in (("HOT", 2), ("BLOCK", 300), ("QUERIES", 3)):  # hot tokens, several blocks and parts
        monkeypatch.setattr(ngram_join, name, value)
    got = ngram_join.similar_components(docs, count_links=True).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and {r["doc_id"]: r["n_links"] for r in got} == links
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs).collect()} == want


def test_matrix_tokens_share():
    """Sets at the bound share as many tokens as candidates must have."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 40, 127, 128, 255, 300, 399, 401, 512, 1500, 4000):
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            x = next(k for k in range(n, -1, -1) if 100 * (n - k) >= 80 * (n + k))
            b = np.unique(np.concatenate([rng.permutation(a)[x:], rng.integers(0, 2**63, x, dtype=np.uint64)]))
            c = np.unique(rng.permutation(a)[: max(1, -(-n * 8 // 10))])
            for y in (b, c):
                assert len(np.intersect1d(ngram_join.tokens(a), ngram_join.tokens(y))) >= max(1, n // 50)


def test_ngram_join_repeated_and_odd_ids(spark):
    """Each row of an id with several texts has the component of its own text, in any order of rows; null ids link nothing."""
    a, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(40))
    near = a.replace("w59", "x")
    rows = [(1, a), (1, other), (7, near), (1, a), (9, other.upper()), (None, near), (5, None), (5, ""), (None, "lonely words")]
    for order in (rows, rows[::-1]):
        got = ngram_join.similar_components(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), count_links=True).collect()
        want = [(1, 56, 1, 2), (1, 56, 1, 2), (7, 56, 1, 2), (1, 36, 1, 1), (9, 36, 1, 1), (None, 56, None, 3), (5, 0, 5, 0), (5, 0, 5, 0), (None, 1, None, 0)]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in ngram_join.similar_components(nulls).collect()] == [(None, 0, None)] * 2
    clash = spark.createDataFrame([(1, a, 0, 0, "x", 0), (2, near, 1, 1, "y", 1)], "doc_id long, text string, cls long, n_shingles long, component_id string, grp long")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.similar_components(clash).collect()) == [(1, 1), (2, 1)]
    assert [tuple(r)[0] for r in ngram_join.keep_one_of_each(clash).collect()] == [1]


def test_ngram_join_crowded_groups(spark):
    """Copies of one text that are near the bound, many of them too far from each other, against brute force."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(70)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.sample(range(70), rng.choice([0, 1, 1, 2, 2, 3, 4])):
            w[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(50))
    rows += [(1000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([4, 30, 60])))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    for count in (False, True):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(df, count_links=count).collect()} == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    up = {i: i for e in edges for i in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: root(a) for e in edges if e[0] != e[1] for a in e}


def test_quality(spark, empty):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.6
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(1, 60))]
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w), "en", 0, ""))
        labels.append((i, int(good), 0))
    rows += [(1000, None, "en", 0, ""), (1001, "", "en", 0, "")]
    table = quality.statistics_table(spark.createDataFrame(rows, SCHEMA))
    model = quality.fit_quality_model(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["id"]: r["score"] for r in quality.score_quality(table, model).collect()}
    assert set(got) == {r[0] for r in rows} and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    held = [(got[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.5) == bool(y) for s, y in held) > 0.95 * len(held)
    none = quality.fit_quality_model(table, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in quality.score_quality(table, none).collect()} == {0.5}
    assert quality.score_quality(quality.statistics_table(empty), none).count() == 0
    knots, values = quality.isotonic(np.array([0.0, 1, 2, 3]), np.ones(4), np.array([0.0, 1, 0.5, 1]))
    assert np.allclose(values, [0, 0.75, 1]) and np.allclose(knots, [0, 1.5, 3])


def test_quality_scores_depend_on_their_row_alone():
    rng = np.random.default_rng(3)
    dim, width = len(quality.STATISTICS), quality.WIDTH
    model = quality.QualityModel(rng.normal(size=dim), rng.uniform(0.5, 2, dim), rng.normal(size=(dim, width)), rng.uniform(0, 6, width), rng.normal(size=width + 1), np.array([-9.0, 9]), np.array([0.0, 1]))
    x = rng.normal(size=(700, dim))
    raw = model.raw(x)
    assert np.allclose(raw, model.expand(x) @ model.weights)
    for n in (1, 2, 3, 5, 8, 17, 255, 257, 400):
        assert (model.raw(x[700 - n :]) == raw[700 - n :]).all() and (model.raw(np.repeat(x[:1], n, 0)) == raw[0]).all()


def test_quality_weights_are_the_ridge_solution(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdeXYZ!.") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 40))), "en", 0, "") for i in range(300)]
    labels = [(i, rng.randrange(2), 0) for i in range(300)]
    table = quality.statistics_table(spark.createDataFrame(rows, SCHEMA).repartition(3))
    model = quality.fit_quality_model(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    part = [r for r in table.collect() if zlib.crc32(str(r["id"]).encode()) % 3 == 0]
    z, y = model.expand(np.array([r["x"] for r in part])), np.array([labels[r["id"]][1] for r in part], float)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(part) * np.eye(z.shape[1]) / 10, z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)


def test_packing(spark, docs, empty):
    path = packing.tokenizer_path()
    enc = packing.encoder(path)
    fresh = Tokenizer.from_file(path)
    texts = [t or "" for _, t, *_ in ROWS] + ["a  b", "a\n b", " lead", "trail ", "don't\nit's", "日本 語\n\nx", "<|endoftext|> a", "b<|endoftext|>", "x\t y", "Été, 12.5%!!", "a\tb\tc\n\n", "x\ty\n\u00a0"]
    rng = random.Random(1)
    parts = ["a", "to", "Ünd", "don't", "x1", "12", ".", ",", "!?", "語", "\u0370", "é", "'s", "_", "#", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u2003", "\x85", "\x1c", "\r\n", "<|endoftext|>", "<|", "\U0001f600", "\u200d", "\u0301"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(10_000)]
    assert [np.frombuffer(enc.encode(t), "<u4").tolist() for t in texts] == [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]
    for group in (60_000, 10):
        seqs, seen = defaultdict(list), defaultdict(dict)
        for r in packing.pack_documents(docs, group=group).collect():
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
            seen[r["doc_id"]][r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
        for s in seqs.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= 2048
        for i, t, *_ in ROWS:
            ids = enc.encode(t or "") + packing.END
            want = {k: (s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(packing.cut(len(ids) // 4))}
            assert seen[i] == want and all(n == 2048 for k, (_, n, _) in want.items() if k)
        if group == 60_000:
            total = sum(n for s in seqs.values() for _, n in s)
            assert len(seqs) <= -(-total // 2048) + 2
    assert packing.pack_documents(empty).count() == 0
    assert packing.cut(4096) == [(0, 2048), (2048, 2048)] and packing.cut(2050) == [(0, 2), (2, 2048)]


def test_sum_of_squares_follows_its_rule():
    rng = np.random.default_rng(0)
    items = rng.integers(1, 21, 200)
    place, offset, fill = packing.sum_of_squares(items, 20)
    have: list[int] = []
    for s, b in zip(items, place, strict=True):
        def cost(bins):
            return sum(c * c for c in np.bincount([20 - f for f in bins if f < 20], minlength=1))

        options = [cost([*have, s])] + [cost([f + s if j == k else f for j, f in enumerate(have)]) for k in range(len(have)) if have[k] + s <= 20]
        if b == len(have):
            have.append(0)
        have[b] += s
        assert cost(have) == min(options)
    assert have == fill


def test_warc(spark):
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(5, "http://a/1", big), (9, "http://a/2", big), (7, None, big), (1, "u", "small"), (2, "u\r\nx", "small"), (3, "n", None), (9, "http://a/2", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for roll, shard in ((1 << 25, 1 << 25), (100, 600)):
        folder = warc.fresh_path(spark, "warc-test")
        files = warc.write_warc(pages, folder, roll_bytes=roll, shard_bytes=shard)
        assert sum(f["records"] for f in files) == len(rows)
        got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, folder, files).collect()), key=repr)
        payload = {i: (h or "").encode() for i, _, h in rows}
        sha = {i: hashlib.sha1(p).hexdigest() for i, p in payload.items()}
        want = [(i, len(payload[i]), sha[i], "revisit" if i in (5, 7) else "response", 9 if i in (5, 7) else None) for i, *_ in rows[:-1]] + [(9, len(payload[9]), sha[9], "revisit", 9)]
        assert got == sorted(want, key=repr)
        again = warc.fresh_path(spark, "warc-test")
        assert [f["sha1"] for f in warc.write_warc(pages.repartition(3), again, roll_bytes=roll, shard_bytes=shard)] == [f["sha1"] for f in files]
    none = warc.fresh_path(spark, "warc-test")
    assert warc.write_warc(pages.limit(0), none) == []
    with pytest.raises(FileExistsError):
        warc.write_warc(pages, none)
    os.remove(f"{folder.removeprefix('file://')}/{warc.MANIFEST}")  # as if the driver had died before it
    assert [f["sha1"] for f in warc.write_warc(pages, folder, roll_bytes=roll, shard_bytes=shard)] == [f["sha1"] for f in files]


def test_warc_records_in_chunks():
    rng = random.Random(5)
    pages = [(k, f"http://a/{k}", rng.randbytes(rng.choice([0, 10, 70_000, 200_000]))) for k in range(300)]
    data = b"".join(warc.page_record(k, u, p, hashlib.sha1(p).hexdigest(), None, 0) for k, u, p in pages)
    got = [(int(h["WARC-Page-ID"]), block.partition(b"\r\n\r\n")[2]) for h, block in warc.records(data)]
    assert got == [(k, p) for k, _, p in pages]
    with pytest.raises(ValueError):
        list(warc.records(data[:-3]))


def test_decontaminate(spark, docs, empty):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6))) for _ in range(n))
    items = [(k, text(30)) for k in range(8)] + [(50, "short"), (51, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def edited(t, share):
        out = list(t)
        for _ in range(int(len(t) * share)):
            out[rng.randrange(len(out))] = "z"
        return "".join(out)

    rows = [(0, text(20) + " " + items[0][1] + " " + text(5)), (1, items[1][1].upper().replace(" ", "\n  ")), (2, text(9) + edited(items[2][1], 0.07)), (3, text(200)), (4, None), (5, ""), (6, items[3][1][: len(items[3][1]) // 2] + text(30)), (7, "short"), (8, items[4][1] + text(3) + items[5][1]), (9, edited(items[6][1], 0.4))]
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}

    def distance(p, t):  # least edits of p against any part of t
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    norm = lambda t: " ".join((t or "").translate(UP).split())
    want = {i: [k for k, p in items if len(norm(p)) >= decontaminate.SHORTEST and distance(norm(p), norm(t)) <= int(len(norm(p)) * decontaminate.BUDGET)] for i, t in rows}
    assert got == want and [i for i, v in want.items() if v] == [0, 1, 2, 8]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert decontaminate.contaminated(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0


def test_decontaminate_counts_thin_hits(spark):
    """An item within its budget is found where its edits are crowded, also beside a much shorter item."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [(1, letters(44)), (2, letters(2000))]
    out = list(items[1][1])
    for block in range(50):  # nine clean bytes, then four edits eight apart, to the full budget of 200
        for k in range(4):
            out[34 * block + 9 + 8 * k] = "#"
    assert out.count("#") == int(2000 * decontaminate.BUDGET)
    rows = [(0, letters(300) + "".join(out) + letters(300)), (1, "".join(out)[::-1]), (2, letters(3000))]
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {0: [2], 1: [], 2: []}


def test_decontaminate_short_items(spark, tmp_path):
    """The query and the pipeline's stage look for short items exactly, at word bounds."""
    items = [(1, "What is  Pi?"), (2, "what is pi?"), (3, "q"), (4, " \n"), (5, None), (6, "été à 3"), (7, "(a)")]
    texts = ["so WHAT\nis pi? yes", "what is pie?", "somewhat is pi?", "what is pi?", "q", "qq q_ 1q", "x (q), y", None, "", "Dans été à 3.", "f(a)b", "été à 30", "What is", "is pi?"]
    want = [[1, 2], [], [], [1, 2], [3], [], [3], [], [], [6], [7], [], [], []]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.op5_decontaminate(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want))
    assert {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()} == {i for i, v in enumerate(want) if not v}


def test_decontaminate_odd_ids_and_passes(spark, monkeypatch):
    """Ids of any type, null ones too; several passes give what one gives; grams that repeat over and over are counted in parts."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    items = [(k if k % 3 else None, text(80)) for k in range(9)] + [(20, "a" * 300), (21, "tiny one")]
    rows = [(k, text(30) + " ".join(t for _, t in items[k : k + 2]) + text(30), 0, "x") for k in range(9)] + [(50, "b" + "a" * 4000, 1, "y"), (51, "Tiny  One!", 1, "y"), (None, None, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, contaminated int, item_ids string").repartition(2)
    want = {k: sorted(({i for i, t in items[k : k + 2]}), key=lambda i: (i is None, i)) for k in range(9)} | {50: [20], 51: [21], None: []}
    for kind in ("smallint", "string", "decimal(9,0)", "bigint"):
        bench = spark.createDataFrame(items, "item_id long, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
        got = {r["doc_id"]: [None if i is None else int(i) for i in r["item_ids"]] for r in decontaminate.contaminated(docs, bench, short_items=True).collect()}
        assert {k: sorted(v, key=lambda i: (i is None, i)) for k, v in got.items()} == {k: v for k, v in want.items()}, kind
    for name, value in (("PAIRS", 5000), ("PASS_BYTES", 300)):
        monkeypatch.setattr(decontaminate, name, value)
        got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(docs, bench, short_items=True).collect()}
        assert got == want
    kept = decontaminate.drop_contaminated(docs, bench, short_items=True)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [None]


def test_sharding(spark, docs, empty):
    got = sharding.shard_documents(docs).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS}
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and set(places) <= set(range(16))
    m = sharding.balanced_map([10] * 64, 4)
    grown = sharding.rebalanced(m, [10] * 64, 5)
    assert grown.version == 2 and set(grown.shard_of) == set(range(5)) and sum(a != b for a, b in zip(m.shard_of, grown.shard_of, strict=True)) < 20
    path = m.save(spark, sharding.fresh_path(spark, "map-test"))
    assert sharding.SlotMap.load(spark, path) == m
    many = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 50 AS INT)) AS text")
    load = lambda rows, shards: [sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)]
    sizes = load(sharding.shard_documents(many).collect(), 16)
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 16
    total, _ = sharding.slot_totals(many, sharding.slot_of("doc_id"), F.octet_length("text") + 1)
    old = sharding.SlotMap.load(spark, sharding.balanced_map(total).save(spark, sharding.fresh_path(spark, "map-test")))
    edited = sharding.rebalanced(old, total, 17)
    sizes = load(sharding.shard_documents(many, slot_map=edited).collect(), 17)
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 17 and sum(a != b for a, b in zip(old.shard_of, edited.shard_of, strict=True)) < 0.1 * len(total)
    assert sharding.shard_documents(empty).count() == 0


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h2>Site</h2></header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><article><header><h1>A &amp; B</h1></header>
    <p><b>First   line<br>goes on.<p>Second &lt;para&gt; <a href="x">link</a>.</p><div class="ad">Buy!</div><p>Third one, a bit longer than the others are.
    <div class="comments"><p>Nice post!</p></div></article><aside>More</aside><form>Mail <input></form><footer>&copy; 2024</footer></body></html>"""
    assert htmltext.main_text(page) == "A & B\n\nFirst line goes on.\n\nSecond <para> link.\n\nThird one, a bit longer than the others are."
    assert htmltext.main_text(None) == "" and htmltext.main_text("") == "" and htmltext.main_text("<p") == "" and htmltext.main_text("<p>just text") == "just text"
    assert htmltext.main_text("<body><nav>x</nav></body>") == ""
    deep = "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000
    assert htmltext.main_text(deep) == "deep text"


def test_html_sibling_sections():
    """Without article or main all sections of the body are the article; a list of links beside them isn't."""
    for count, k, link, wrap in product((2, 3, 4, 6), (1, 2, 3, 5), ("", "<p><a href='x'>on</a></p>"), ("body", "div")):
        parts = [[f"s{s}p{i} " + "word " * (60 if i else 20) + "." for i in range(k if s else 5)] for s in range(count)]
        page = "".join("<section>" + "".join(f"<p>{t}</p>" for t in p) + link + "</section>" for p in parts)
        links = "<div><ul>" + "".join(f"<li><a href='{i}'><span><b>away {i}</b></span></a></li>" for i in range(9)) + "</ul></div>"
        top = f"<body>{links}<{wrap}><h1>Head</h1>See <a href='y'>this</a> first.{page}</{wrap}>"
        got = htmltext.main_text(top)
        want = ["Head", "See this first."] + [t for p in parts for t in [*p, *(["on"] if link else [])]]
        assert got == "\n\n".join(want), (count, k, link, wrap)
    assert htmltext.main_text("<section><p>a b<p>c d<p>e f</section><section><p>g h</section>") == "a b\n\nc d\n\ne f\n\ng h"


def test_html_names_on_wrappers():
    """A class or id with a word of boilerplate doesn't take the article with it; the boilerplate itself goes."""
    post = "".join(f"<p>post {i} " + "word " * 30 + ".</p>" for i in range(4))
    want = "\n\n".join(f"post {i} " + "word " * 30 + "." for i in range(4))
    side = "<div class='sidebar'><p>aside " + "other " * 20 + "</p></div><div id='comments'><article><p>Nice one!</p></article></div>"
    for name in ("content-sidebar-wrap", "has-sidebar", "no-comments", "page-with-header", "widget-area main", "sidebar-wrapper"):
        for tag in ("main", "article"):
            for body in (f"<{tag}>{post}</{tag}>{side}", f"{side}<div class='no-comments'><{tag}>{post}</{tag}></div>"):
                assert htmltext.main_text(f"<body><div class='{name}'>{body}</div><div class='ad'>Buy!</div></body>") == want, (name, body)
        assert htmltext.main_text(f"<body><div id='{name}'>{post}</div><div class='ad'>Buy!</div></body>") == want, name
        assert htmltext.main_text(f"<body><article><h1>Head</h1><div class='{name}'>{post}</div></article></body>") == "Head\n\n" + want, name
    long = "<div class='comments-area'><ol class='comment-list'>" + "<li><article><p>I say so too.</p></article></li>" * 60 + "</ol></div>"
    for tag in ("article", "main", "div"):
        assert htmltext.main_text(f"<body><{tag}>{post}</{tag}>{long}</body>") == want
        assert htmltext.main_text(f"<body><div class='has-comments'><{tag}>{post}</{tag}{'>' + long}</div></body>") == want


def test_html_names_that_hold_a_word_of_boilerplate():
    """Only whole names count: "share-price" in an article stays."""
    page = "<body><article><h1>Head</h1><p class='share-price'>Up by three.</p><div class='social-policy'><p>More of it.</p></div><div class='share-buttons'>Share!</div></article></body>"
    assert htmltext.main_text(page) == "Head\n\nUp by three.\n\nMore of it."


def test_html_densities_decide():
    """With neither article, main nor names, link lists beside the text go and the text stays."""
    links = "<div>" + "".join(f"<span><a href='{k}'>topic {k}</a></span> " for k in range(25)) + "</div>"
    text = "".join(f"<p>paragraph {k} " + "word " * 40 + "end.</p>" for k in range(6))
    got = htmltext.main_text(f"<body>{links}<div><div>{text}</div></div>{links}</body>")
    assert got == "\n\n".join(f"paragraph {k} " + "word " * 40 + "end." for k in range(6))


def test_html_broken_pages_take_linear_time():
    for page in ("<div>" * 100_000 + "</p>" * 100_000, "<div class=\"x>" * 50_000, "<div a='>" * 50_001, "<b><i>" * 50_000 + "<div>" * 20_000, "<title>" * 50_000, "<li>x" * 100_000, "</a>" * 100_000, "<tr><td>" * 50_000):
        began = time.process_time()
        htmltext.main_text(page + "<p>end")
        assert time.process_time() - began < 12, page[:20]


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, "<p>x y</p>"), (2, None, "<p>x y</p>")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract_pages(df).collect()) == [(1, "", 0), (2, "x y", 3), (2, "x y", 3)]
    assert htmltext.extract_pages(df.limit(0)).count() == 0


def test_language(spark, empty):
    rng = random.Random(4)
    word = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(word[v]) for _ in range(5)) for _ in range(20)), v, 0, "") for i, v in enumerate(["aa", "bb"] * 60)]
    odd = [(500, None, "aa", 0, ""), (501, "", "aa", 0, ""), (502, "12 !! ??", None, 0, ""), (503, "abc" * 40_000, None, 0, "")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    model = langid.fit_language_model(df)
    got = {r["doc_id"]: r for r in langid.identify_languages(df, model).collect()}
    assert all(got[i]["lang_pred"] == v and not got[i]["rejected"] for i, _, v, *_ in rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (500, 501, 502)) and got[503]["lang_pred"] == "aa"
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} | {503}
    assert langid.identify_languages(empty, langid.fit_language_model(empty)).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    """Of 4,000 rows a language, one id repeated and some texts very long, the model learns from so many rows and bytes."""
    taken = {}
    monkeypatch.setattr(langid, "train", lambda texts, langs: taken.update(texts=texts, langs=langs))
    rows = [(i, f"text {i}", "aa" if i % 2 else "bb", 0, "") for i in range(8000)] + [(1, "z", "aa", 0, "")] * 3000
    rows += [(9000 + i, "q" * 70_000, "cc", 0, "") for i in range(9)] + [(9000 + i, "short", "cc", 0, "") for i in range(9)] + [(None, "no id", "aa", 0, "")]
    langid.fit_language_model(spark.createDataFrame(rows, SCHEMA), per_lang=5)
    count = {v: taken["langs"].count(v) for v in ("aa", "bb", "cc")}
    assert count["aa"] == count["bb"] == 5 and count["cc"] == 2 and set(map(len, taken["texts"])) <= set(range(10))
    assert all(zlib.crc32(t.split()[1].encode()) % 5 for t in taken["texts"] if t.startswith("text"))


def test_language_sample_takes_no_python_workers(spark, monkeypatch):
    """Rows given to createDataFrame pass through workers of a second kind, which stay on each executor beside the operators' own."""
    rows = spark.createDataFrame([(i, "abc abd" if i % 2 else "xyz xyw", "aa" if i % 2 else "bb", 0, "") for i in range(60)], SCHEMA)

    def refused(*args, **more):
        raise AssertionError("createDataFrame")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    assert langid.fit_language_model(rows).langs == ["aa", "bb"]


def test_workers_keep_one_operators_cache(monkeypatch):
    """A task of another operator drops what packing keeps in a worker, tasks of packing don't; freed memory goes back after each, also a broken one."""
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    packing.encoder(packing.tokenizer_path()).encode("some words")
    assert list(common.tidy(iter, "packing")([1, 2])) == [1, 2] and packing._encoders and len(given) == 1
    assert list(common.tidy(iter)([3])) == [3] and not packing._encoders and len(given) == 3
    with pytest.raises(ZeroDivisionError):
        list(common.tidy(lambda batches: (1 // b for b in batches))([0]))
    assert len(given) == 4


def test_pipeline(spark, tmp_path):
    """The chained stages keep what a brute-force chain of them keeps, and pack every token of it."""
    rng = random.Random(8)
    letters = {"aa": "abcde", "bb": "vwxyz"}
    word = lambda v: "".join(rng.choice(letters[v]) for _ in range(5))
    rows = [(i, " ".join(word(v) for _ in range(60)), v, 0, "") for i, v in enumerate(["aa", "bb"] * 60)]
    odd = {500: None, 501: "", 502: "12 !! ??"}
    copy = lambda i, j: (i, rows[j][1].upper(), rows[j][2], 0, "")
    near = lambda i, j: (i, " ".join([*rows[j][1].split()[:-1], word(rows[j][2])]), rows[j][2], 0, "")
    rows += [copy(200 + j, j) for j in range(0, 20, 2)] + [near(300 + j, j) for j in range(1, 40)]
    items = [(k, rows[j][1][30:150]) for k, j in enumerate((3, 50, 77))]
    rows += [(400 + k, " ".join(word("aa") for _ in range(30)) + " " + t + " " + " ".join(word("aa") for _ in range(30)), "aa", 0, "") for k, (_, t) in enumerate(items)]
    rows += [(i, t, None, 0, "") for i, t in odd.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r for r in rows if r[0] not in odd]
    last = {r[1].translate(UP): r[0] for r in sorted(left, key=lambda r: r[0])}
    left = [r for r in left if last[r[1].translate(UP)] == r[0]]
    parts = brute_components(left)
    left = [r for r in left if parts[r[0]][1] == r[0]]
    left = [r for r in left if not any(t in r[1].translate(UP) for _, t in items)]
    seen = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        seen[r["doc_id"]] += r["length"]
    enc = packing.encoder(packing.tokenizer_path())
    assert dict(seen) == {r[0]: len(enc.encode(r[1]) + packing.END) // 4 for r in left} and len(left) < len(rows) - 50


def test_line_dedup(docs, empty):
    first, gone = {}, defaultdict(set)
    for i, t, *_ in sorted(ROWS, key=lambda r: r[0]):
        a = (t or "").split("\n")
        for k in range(len(a) - 2):
            w = tuple(a[k : k + 3])
            if "".join(w).strip(" ") and first.setdefault(w, (i, k)) != (i, k):
                gone[i] |= {k, k + 1, k + 2}
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t, *_ in ROWS}
    out = line_dedup.dedup_lines(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["text"] for i, r in got.items()} == want and any(gone.values())
    assert all(r["n_removed"] == len(gone[i]) and r["n_lines"] == (0 if r["text"] is None else len(dict((x[0], x[1]) for x in ROWS)[i].split("\n"))) for i, r in got.items())
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_is_linear_in_lines(spark):
    lines = [f"line {i}" for i in range(30_000)]
    df = spark.createDataFrame([(1, "\n".join(lines), "x"), (2, "\n".join([*lines[:20_000], "own", *lines[20_000:]]), "y")], "doc_id long, text string, cut string")
    began = time.time()
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["cut"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: ("\n".join(lines), 30_000, 0, "x"), 2: ("own", 30_001, 30_000, "y")}
    assert time.time() - began < 60
