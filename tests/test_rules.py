"""Folds and rules that SQL can't say, against plain loops."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tamarack.functions import prefixes, tokens
from tamarack.functions import text as T
from tamarack.operators import align, segments, sequences


def _merged(en, forward):
    out = []
    for e in en:
        one = len("".join(c for c in e if c not in ".,?!:;-").split()) <= 1
        first = forward and len(out) == 1 and out[0][1]
        if out and (one or first):
            out[-1] = (out[-1][0] + " " + e, False)
        else:
            out.append((e, one))
    return [e for e, _ in out]


def test_merge_one_word_equals_the_loop(spark):
    rng = random.Random(3)
    rows = [(i, [" ".join(rng.choice("ab") for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(rng.randint(0, 7))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a array<string>")
    got = df.select("i", segments.merge_one_word(F.col("a"), F.col("a"))["en"].alias("b"), segments.merge_one_word(F.col("a"), F.col("a"), True)["en"].alias("f")).collect()
    for r in got:
        assert r["b"] == _merged(rows[r["i"]][1], False) and r["f"] == _merged(rows[r["i"]][1], True)
    odd = spark.createDataFrame([(["a b"], ["x", "y"])], "e array<string>, z array<string>").select(segments.merge_one_word(F.col("e"), F.col("z")).alias("m")).first()["m"]
    assert odd["en"] == ["a b"] and odd["zh"] == ["x", "y"]


def test_collapse_is_unicode_white_space(spark):
    cases = ["a b", "  a \t b\u00a0", "a\n\n b", "\u3000", "", None, "x  y\u2009z"]
    got = [r["t"] for r in spark.createDataFrame([(c,) for c in cases], "c string").select(T.collapse(F.col("c")).alias("t")).collect()]
    assert got == [" ".join((c or "").split()) for c in cases]


def test_running_pieces(spark):
    df = spark.createDataFrame([("u", 2, "c.", 9), ("u", 1, "a", 8), ("u", 3, None, 7), ("v", 1, ",", 6)], "k string, n int, p string, extra int")
    got = {(r["k"], r["n"]): (r["observed"], r["extra"]) for r in sequences.running_pieces(df, "k", "n", "p").collect()}
    assert got == {("u", 1): ("a", 8), ("u", 2): ("a c.", 9), ("u", 3): ("a c.", 7), ("v", 1): (",", 6)}


def test_windows_without_a_match(spark):
    df = spark.createDataFrame([(["so it is"], [("So", 0.0, 0.5), ("it", 0.5, 0.7), ("is.", 0.7, 1.0)], ["none"])], "c array<string>, w array<struct<word:string,start:double,end:double>>, n array<string>")
    r = df.select(align.chunk_intervals(F.col("c"), F.col("w")).alias("i"), align.emission_windows(align.chunk_intervals(F.col("n"), F.col("w")), F.lit(3.0)).alias("e")).first()
    assert (r["i"][0]["start"], r["i"][0]["end"]) == (0.0, 1.0) and r["e"] == [[]]


def test_quorum_backoff_and_shortest(spark):
    rows = [("abcx", ["abcd", "abce", "q"], 2, "abc"), ("然后好的", ["同时好的吧", "好的呀", "另外不"], 2, "好的"), ("zz", ["同时好啊", "而且好吗", "x"], 2, "好"), ("zz", ["好"], 2, "")]
    df = spark.createDataFrame(rows, "o string, f array<string>, k int, want string")
    got = df.select(prefixes.quorum_backoff(F.col("o"), F.col("f"), F.col("k")).alias("g"), "want", prefixes.shortest(F.col("f")).alias("s"), "f").collect()
    for r in got:
        assert r["g"] == r["want"] and r["s"] == min(r["f"], key=len)


def test_texts_for_alignment(spark):
    df = spark.createDataFrame([("  e\u0301 \u200ba b\nsecond", "[A1]: “候选A：好 的"), (None, None)], "a string, b string")
    got = df.select(T.clean_translation(F.col("a")).alias("a"), T.sanitized_vote(F.col("b")).alias("b")).collect()
    assert (got[0]["a"], got[1]["a"], got[1]["b"]) == ("\u00e9ab", "", "") and got[0]["b"].endswith("好的") and "[" not in got[0]["b"]


def test_pending_tokens(spark):
    df = spark.createDataFrame([([5, None, 7, 8], ["你", "x", "a", "�"])], "ids array<int>, texts array<string>")
    r = df.select(tokens.split_pending(F.col("texts"), F.col("ids")).alias("s"), tokens.clean_prefix_length(F.array(F.lit("�"), F.lit("�"))).alias("n")).first()
    assert r["s"]["kept"] == [5, 8] and [(x["position"], x["reason"]) for x in r["s"]["removed"]] == [(1, "missing_token_id"), (2, "ascii_letters")] and r["n"] == 0


def test_prefix_votes_counts_blank_first_letters(spark, tmp_path):
    texts = ["", None, " a", "  ", "b", "B", " ", "\tx", "\nx", "\u00a0x", "，a", "们", "为", "<", ">", "İx", "i", "I", "\u3000", "é", "É"]
    rows = [(i, texts[(i * 7 + i // 8) % len(texts)]) for i in range(-20, 200)] + [(2**53 + 1 + k, t) for k, t in enumerate(" a b c".split(" ") * 3)] + [(None, " "), (None, "a"), (400, " "), (401, " "), (402, "z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()["prefix_votes"](spark, str(tmp_path)).select("g", "n", "share").collect()
    want = con.execute(f"SELECT g, n, share FROM ({entry.oracle_sql()['prefix_votes']})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
