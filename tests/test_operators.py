"""Operators against worked rows and plain loops."""

import random

from pyspark.sql import functions as F

from tamarack.operators import align, audit, external, scoring, segments, sequences, votes
from tamarack.sources.readers import parse_textgrid, parse_trace
from tamarack.streaming import policies

WORDS = [("so", 0.0, 0.5), ("we", 0.5, 0.9), ("so", 2.0, 2.2), ("they", 2.2, 2.5)]


def test_intervals_and_windows(spark):
    df = spark.createDataFrame([(["so we", "zzz", "so they"], WORDS)], "c array<string>, w array<struct<word:string,start:double,end:double>>")
    iv = align.chunk_intervals(F.col("c"), F.col("w"))
    r = df.select(iv.alias("i"), align.emission_windows(iv, F.lit(3.0)).alias("a"), align.emission_windows(iv, F.lit(None).cast("double"), 1.0, "drop").alias("d"), align.strict_match(F.col("c"), F.transform("w", lambda w: w["word"])).alias("s")).first()
    assert [tuple(x) for x in r["i"]] == [(0.0, 0.9), (None, None), (2.0, 2.5)]
    assert r["a"] == [[0], [], [2], [1]] and r["d"] == [[0], [], [2]] and r["s"] == 1


def test_window_borders(spark):
    df = spark.createDataFrame([(0.96,), (2.88,), (8.64,), (10.56,)], "e double")
    assert [r[0] for r in df.select(align.window_of_seconds(F.col("e"), 0.96)).collect()] == [0, 2, 8, 11]
    assert [r[0] for r in df.select(align.window_of_ms(F.round(F.col("e") * 1000).cast("long"), 960)).collect()] == [0, 2, 8, 10]


def test_greedy_match_against_a_loop(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 6))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(60)]

    def loop(tokens, words):
        at, out = 0, []
        for t in tokens:
            hit = next((k for k in range(at, len(words)) if words[k] == t), None)
            out.append(0 if hit is None else hit + 1)
            at = at if hit is None else hit + 1
        return out

    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t array<string>, w array<string>").select("i", align.greedy_positions(F.col("t"), F.col("w")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == [loop(*r) for r in rows]


def test_merging(spark):
    en, zh = ["Houston", "issued a series", "of", "warnings.", "it's", "very late"], ["休", "发出一系列", "的", "警报。", "这", "很晚"]
    df = spark.createDataFrame([(en, zh)], "e array<string>, z array<string>")
    r = df.select(segments.merge_one_word(F.col("e"), F.col("z")).alias("y"), segments.merge_one_word(F.col("e"), F.col("z"), True).alias("g")).first()
    assert r["y"]["en"] == ["Houston", "issued a series of warnings. it's", "very late"] and r["y"]["zh"] == ["休", "发出一系列的警报。这", "很晚"]
    assert r["g"]["en"] == ["Houston issued a series of warnings. it's", "very late"] and r["g"]["zh"] == ["休发出一系列的警报。这", "很晚"]
    assert spark.createDataFrame([(["你", "", "好", "吗", "。"],)], "a array<string>").select(segments.regroup(F.col("a"), 2)).first()[0] == ["你", "好吗", "。"]


def test_punctuation_follows_the_source(spark):
    df = spark.createDataFrame([(["Hello, there.", "I am", "fine."], ["你好", "。我", "很好"])], "e array<string>, z array<string>")
    r = df.select(segments.sync_target_punct(F.col("e"), F.col("z")).alias("m"), segments.sync_target_punct(F.col("e"), F.col("z"), True).alias("i")).first()
    assert r["m"] == ["你好。", "我", "很好"] and r["i"] == ["你好。", "我", "很好。"]


def test_restoring():
    assert segments.restore_segments(["hello there", "", "i am"], "Hello, there. I am!") == ["Hello, there.", "", "I am!"]
    assert segments.restore_segments(["hello you"], "Hello there") is None
    assert segments.restore_segments(["hello there"], "Hello there", case_sensitive=False) == ["hello there"]


def test_sentences_and_spans(spark):
    df = spark.createDataFrame([("u", 0, ["The cat", "sat"], True), ("u", 1, ["on the", "mat."], True), ("v", 0, ["x"], False)], "k string, i int, s array<string>, ok boolean")
    r = {x["k"]: x for x in segments.concat_sentences(df, "k", "i", ["s"], "ok").collect()}
    assert r["u"]["s"] == ["The cat", "sat", "on the", "mat."] and [tuple(x) for x in r["u"]["spans"]] == [(0, 2), (2, 4)]
    assert r["v"]["s"] is None and r["v"]["error"] == "sentence_failed"


DISTS = {1: {1: 0.6, 2: 0.3, 3: 0.1}, 2: {2: 0.5, 1: 0.3, 4: 0.2}, 3: {2: 0.7, 5: 0.2, 1: 0.1}}


def test_votes(spark):
    df = spark.createDataFrame([(0, v, t, p) for v, d in DISTS.items() for t, p in d.items()], "step int, voter int, token int, p double")
    for policy in ({"top_k": 2}, {"top_k": 3}, {"top_p": 0.8}, {"min_p": 0.25}):
        r = votes.intersection_vote(df, ["step"], "voter", **policy).first()
        assert r["token"] == 2 and abs(r["mean_p"] - 0.5) < 1e-9
    assert votes.soft_vote(df, ["step"], "voter").first()["token"] == 2
    assert votes.trie_vote(["abcd", "abce", "abx"], "a", 0.6, 3, 1) == "bc"


def test_alignment(spark):
    df = spark.createDataFrame([([(2, 0), (0, 1), (3, 1), (1, 2)],)], "p array<struct<s:int,t:int>>")
    r = df.select(sequences.monotone_alignment(F.col("p"), F.lit(5), F.lit(4)).alias("m"), sequences.safe_target(F.col("p"), F.lit(3)).alias("s")).first()
    assert [tuple(x) for x in r["m"]] == [(2, 0), (3, 1), (3, 2), (4, 3)] and r["s"] == 1


def test_punctuation_diff(spark):
    df = spark.createDataFrame([(1, "Well, yes. It's ok!", "Well yes.. It's ok,")], "k int, a string, b string")
    r = audit.punct_diff(df, "k", "a", "b").first()
    assert (r["missing"], r["extra"]) == ("!", ".")


def test_scores(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (9.0,)], "p double")
    assert [r[0] for r in df.select(scoring.passes(F.col("p"), 3.0)).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(scoring.passes(F.col("p"), 3.0, True)).collect()] == [True, True, False, False]


def test_calls_keep_every_row(spark):
    def client():
        def ask(prompts):
            if any(p == "bad" for p in prompts):
                raise ValueError("no")
            return [p.upper() for p in prompts]

        return ask

    rows = {r["i"]: (r["answer"], r["error"]) for r in external.call_model(spark.createDataFrame([(0, "a"), (1, "bad"), (2, None), (3, "c")], "i int, q string").coalesce(1), "q", client).collect()}
    assert rows[0] == ("A", None) and rows[3] == ("C", None) and rows[2] == (None, None) and rows[1][0] is None and "no" in rows[1][1]


def test_policies(spark):
    deltas = ["", "还", "有", "这些", "吧"]
    at = {"n": 0}

    def make(look):
        def translate(observed, committed):
            t = len(observed.split()) - 1
            return committed + "".join(deltas[t : t + look])

        return translate, lambda source, committed: deltas[-1]

    w = policies.WaitK(*make(1), k=3).run(["a", "b", "c", "d", "e"])
    assert [a for a, _ in w] == ["READ", "READ", "WRITE", "WRITE", "WRITE"] and [d for _, d in w] == ["", "", "有", "这些", "吧"]
    la = policies.LocalAgreement(lambda o, c: {1: "ab", 2: "abc", 3: "abcd"}.get(len(o.split()), "abx"), lambda s, c: "!", 2).run(["p", "q", "r", "s"])
    assert [d for _, d in la] == ["ab", "", "c", "!"]
    assert not at["n"]
    df = spark.createDataFrame([("u", ["a", "b", "c"]), ("v", None)], "utt_id string, chunks array<string>")
    got = {r["utt_id"]: r for r in policies.run_batch(df, lambda: policies.WaitK(lambda o, c: o.upper(), lambda s, c: s.upper()[len(c) :], 2)).collect()}
    assert got["u"]["prediction"] == "A B C" and got["u"]["actions"] == ["READ", "WRITE", "WRITE"] and got["v"]["actions"] == []


def test_parsers():
    grid = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = 2.5\ntiers? <exists>\nsize = 1\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        name = "words"\n        xmin = 0\n        xmax = 2.5\n        intervals: size = 2\n        intervals [1]:\n            xmin = 0\n            xmax = 0.5\n            text = "so"\n        intervals [2]:\n            xmin = 0.5\n            xmax = 2.5\n            text = ""\n'
    assert parse_textgrid(grid) == ([("so", 0.0, 0.5)], 2.5)
    assert parse_textgrid("broken") == ([], None)
    header, chunks = parse_trace("# utt: x\nChunk 1/2\n future[0] (primary): 'hi'\n step=1 accepted='a' pending='ab'\n")
    assert header == {"utt": "x"} and chunks[0]["futures"][0]["text"] == "hi" and chunks[0]["steps"][0]["pending"] == "ab"
