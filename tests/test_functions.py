"""Scalar functions against hand-worked rows."""

import math

from pyspark.sql import functions as F

from tamarack.functions import metrics, parsing, prefixes
from tamarack.functions import text as T


def one(spark, schema, row, **cols):
    return spark.createDataFrame([row], schema).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def test_normalising(spark):
    x = F.col("x")
    got = one(spark, "x string", ("It's 3,000 km — COVID-19!",), a=T.normalize(x), b=T.normalize_lenient(x), c=T.letters_only(x))
    assert got == {"a": "it's 3 000 km covid 19", "b": "it's 3000 km covid19", "c": "it s km covid"}
    assert one(spark, "x string", ("1,23 4,567,890",), a=T.normalize_lenient(x))["a"] == "1 23 4567890"
    assert one(spark, "x string", (None,), a=T.normalize(x), n=F.size(T.word_tokens(x))) == {"a": "", "n": 0}
    assert one(spark, "x string", (" a 　b\n",), a=T.collapse(x), n=T.nonspace_length(x)) == {"a": "a b", "n": 2}


def test_punctuation(spark):
    x = F.col("x")
    zh = T.ZH_SENT + T.ZH_CLAUSE
    assert one(spark, "x string", ("好的。”  ",), a=T.trailing_punct(x, zh), b=T.insert_before_closers(x, F.lit("！"))) == {"a": "。", "b": "好的。！”  "}
    assert one(spark, "x string", ("他说,",), a=T.full_width_tail(x))["a"] == "他说，"
    assert one(spark, "x string", ('他说 "hello."',), a=T.full_width_tail(x))["a"] == '他说 "hello."'
    assert one(spark, "x string", ("Hi. You? Yes!",), a=T.zh_sentence_flag(x, F.lit("好")), b=T.zh_sentence_flag(x, F.lit("好。"), 2))["a"] == "no_target_sentence_end"


def test_joining(spark):
    a = F.col("a")
    assert one(spark, "a array<string>", (["Hello", "", ",", "(", "world", ")", None, "again"],), j=T.join_pieces(a))["j"] == "Hello, (world) again"
    assert one(spark, "a array<string>", (["你", "", "好"],), s=T.join_source(a), t=T.join_target(a)) == {"s": "你 好", "t": "你好"}


def test_prefixes(spark):
    f = ["民间故事总是", "民间故事是", "民间故", "民间", "民众"]
    want = {1: "民间故事总是", 2: "民间故事", 3: "民间故", 4: "民间", 5: "民", 6: ""}
    got = one(spark, "a array<string>", (f,), **{f"k{k}": prefixes.quorum_prefix(F.col("a"), F.lit(k)) for k in want})
    assert got == {f"k{k}": v for k, v in want.items()}
    got = one(spark, "a array<string>", (["abcd", "abxy", "abc"],), c=prefixes.lcp_chars(F.col("a")), w=prefixes.lcp_words(F.array(F.lit("a b c"), F.lit("a b d"))), n=prefixes.lcp_words(F.array(F.lit("x"), F.lit("y"))))
    assert got == {"c": "ab", "w": "a b", "n": ""}
    assert one(spark, "c string, d string", ("你好吗", "吗我们"), a=prefixes.strip_overlap(F.col("c"), F.col("d")))["a"] == "我们"
    assert prefixes.trim_repetition("x" + "abcdefgh" * 4) == "xabcdefgh"


def test_parsing(spark):
    x = F.col("x")
    rows = [("['a', \"b's\"]", ["a", "b's"]), ("['a', None]", ["a", ""]), ("plain", ["plain"]), ("nan", []), (None, []), ("['\\xa0x']", ["\xa0x"])]
    got = [r["a"] for r in spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, x string").select("i", parsing.list_literal(x).alias("a")).orderBy("i").collect()]
    assert got == [b for _, b in rows]
    got = one(spark, "x string", ("utt_en000_00000000_0017",), a=parsing.utt_language(x), b=parsing.utt_partition(x), c=parsing.recording_of(x))
    assert got == {"a": "en000", "b": "00000000", "c": "utt_en000_00000000"}
    assert one(spark, "x string", ("<think>no</think> yes <think>open",), a=parsing.clean_model_text(x))["a"] == "yes"
    assert one(spark, "x string", ("2. b\n1. a\n3. a",), a=parsing.numbered_list(x))["a"] == ["a", "b"]
    assert one(spark, "x string", ('well {"score": 130}',), a=parsing.judge_score(x))["a"] == 100.0
    order = [r["x"] for r in spark.createDataFrame([("f10",), ("f9",), ("f1",)], "x string").orderBy(parsing.natural_key(x)).collect()]
    assert order == ["f1", "f9", "f10"]


def test_metrics(spark):
    assert math.isnan(metrics.char_bleu_score("", "x"))
    assert abs(metrics.char_bleu_score("abcd", "abcd") - 100) < 1e-9
    got = one(spark, "h string, r string", ("abc", "abd"), b=metrics.char_bleu(F.col("h"), F.col("r")))
    assert abs(got["b"] - metrics.char_bleu_score("abc", "abd")) < 1e-12

    def plain(src, out, act, ref):
        times, read = [], 0
        for s, d, a in zip(src, out, act, strict=True):
            read += len(s.split())
            times += [read] * len(d.strip()) if a == "WRITE" else []
        n, x = max(len("".join(out)), len(ref.replace(" ", ""))), read
        return sum((times[i] if i < len(times) else x) - i * x / n for i in range(n)) / n

    row = (["a b", "c", "d e f"], ["", "xy", "zzz"], ["READ", "WRITE", "WRITE"], "xy zzzz")
    got = one(spark, "s array<string>, d array<string>, a array<string>, r string", row, v=metrics.laal(*(F.col(c) for c in "sdar")))["v"]
    assert abs(got - plain(*row)) < 1e-12
    assert math.isnan(one(spark, "s array<string>, d array<string>, a array<string>, r string", (["a"], [""], ["READ"], "x"), v=metrics.laal(*(F.col(c) for c in "sdar")))["v"])
