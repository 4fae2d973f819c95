"""Model output, list literals, keys and paths (SCL-30..65, SRC-20, FLT-24)."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.text import WS, blank, strip


def clean_model_text(c: Column) -> Column:
    """SCL-30: without reasoning blocks, closed or not, cut at an end token."""
    t = F.regexp_replace(blank(c), "(?is)<think>.*?</think>", "")
    t = F.regexp_replace(t, "(?is)<think>.*$", "")
    return strip(F.regexp_replace(t, "(?s)(?:<\\|im_end\\|>|<\\|endoftext\\|>|</s>).*$", ""))


def clean_llm_output(c: Column) -> Column:
    """SCL-31: the same, without quotes around."""
    return F.btrim(F.btrim(clean_model_text(c), F.lit('"')), F.lit("'"))


def strip_markdown(c: Column) -> Column:
    """SCL-34: without emphasis, code and heading marks around the text."""
    return strip(F.regexp_replace(F.regexp_replace(strip(blank(c)), "^(?:[*_`#>]+\\s*)+", ""), "[*_`]+$", ""))


def clean_continuation(observed: Column, raw: Column, max_words: int = 15) -> Column:
    """SCL-35: first line, without the observed text it repeats, of ``max_words`` words at most."""
    line = strip(F.split_part(strip(blank(raw)), F.lit("\n"), F.lit(1)))
    seen = F.lower(strip(observed))
    rest = F.when(F.startswith(F.lower(line), seen), strip(F.substr(line, F.length(seen) + 1))).otherwise(line)
    words = F.filter(F.split(rest, "\\s+"), lambda w: w != "")
    return F.when(F.size(words) > max_words, F.array_join(F.slice(words, 1, max_words), " ")).otherwise(strip(rest))


def first_sentence(c: Column) -> Column:
    """SCL-36: up to the first full stop, question or exclamation mark that ends a word; else all."""
    hit = F.regexp_extract(blank(c), "(?s)^(.*?[.!?])(?:\\s|$)", 1)
    return F.when(hit != "", hit).otherwise(blank(c))


def numbered_list(c: Column) -> Column:
    """SCL-37, SRT-09: items of '1. text' lines in the order of their numbers, without repeats."""
    lines = F.filter(F.split(blank(c), "\n"), lambda x: x.rlike("^\\s*\\d+\\s*[.):]\\s*\\S"))
    items = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^\\s*(\\d+)", 1).try_cast("int").alias("k"), strip(F.regexp_extract(x, "^\\s*\\d+\\s*[.):]\\s*(.*)$", 1)).alias("t")))
    return F.array_distinct(F.transform(F.array_sort(items), lambda i: i["t"]))


def json_block(c: Column) -> Column:
    """SCL-39: from the first brace to the last."""
    return F.regexp_extract(blank(c), "(?s)(\\{.*\\})", 1)


def safe_json(c: Column, schema: str) -> Column:
    """SCL-40: parsed as it stands, else from its brace block; null if neither parses."""

    def whole(t: Column) -> Column:  # what doesn't parse would give a struct of nulls
        return F.when(t.rlike("^\\s*\\{") & F.get_json_object(t, "$").isNotNull(), t)

    return F.from_json(F.coalesce(whole(c), whole(json_block(c))), schema)


def judge_score(c: Column, field: str = "score") -> Column:
    """SCL-38, SCL-49: a whole number in the first flat JSON object, or on a line 'score: n'; 0 without; kept in 0..100."""
    block = F.regexp_extract(blank(c), "(\\{[^{}]*\\})", 1)
    found = F.coalesce(F.get_json_object(F.when(block != "", block), f"$.{field}").try_cast("double"), F.regexp_extract(blank(c), f"(?i){field}\\D*(-?\\d+(?:\\.\\d+)?)", 1).try_cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(found, F.lit(0.0))))


def coerce_number(c: Column) -> Column:
    """SCL-52: struct(whole, real, text): the narrowest of them is set."""
    whole, real = c.try_cast("bigint"), c.try_cast("double")
    exact = c.rlike("^\\s*[+-]?\\d+\\s*$")
    return F.struct(F.when(exact, whole).alias("whole"), F.when(~exact, real).alias("real"), F.when(~exact & real.isNull(), c).alias("text"))


def list_literal(c: Column) -> Column:
    """SCL-41..43, SCL-53, SCL-54: a Python list of strings; JSON-like cells by the JSON reader, others by a literal parser.

    What isn't a list is one element; null, blank and 'nan' are none. A None inside becomes ''.
    """
    plain = c.rlike("^\\s*\\[") & ~c.rlike("\\\\x|\\bNone\\b|\\\\N|\\\\0|[uUbBrR]['\"]") & ~c.rlike("\\\\u")
    fast = F.from_json(F.when(plain, c), "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    empty = c.isNull() | (strip(blank(c)) == "") | (F.lower(strip(blank(c))) == "nan")
    slow = _literal(F.when(fast.isNull() & ~empty, c))
    return F.when(empty, F.array().cast("array<string>")).otherwise(F.coalesce(fast, slow))


def _literal_list(x: str | None) -> list[str] | None:
    if x is None:
        return None
    try:
        v = ast.literal_eval(x.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return [x.strip()]
    return ["" if e is None else str(e) for e in v] if isinstance(v, (list, tuple)) else [str(v)]


def _literal(c: Column) -> Column:
    @F.pandas_udf("array<string>")
    def parse(cells: pd.Series) -> pd.Series:
        return pd.Series([_literal_list(x) for x in cells], dtype=object)

    return parse(c)


def token_id(c: Column) -> Column:
    """SCL-44: N of 'token_id:N'."""
    return F.regexp_extract(c, "^token_id:(\\d+)$", 1).try_cast("bigint")


def probabilities(logprobs: Column) -> Column:
    """SCL-45, SCL-57: {token id: exp(log probability)} of a {'token_id:N': lp} map; other keys are left out."""
    kept = F.map_filter(logprobs, lambda k, _: token_id(k).isNotNull())
    return F.transform_values(F.transform_keys(kept, lambda k, _: token_id(k)), lambda _, v: F.exp(v))


def natural_key(c: Column) -> Column:
    """SCL-46: sorts like the name with its numbers as numbers."""
    parts = F.regexp_extract_all(c, F.lit("(\\d+|\\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\d"), F.lpad(F.regexp_replace(p, "^0+(?=\\d)", ""), 20, "0")).otherwise(F.lower(p))), "")


def utt_language(c: Column) -> Column:
    """SCL-60, first part."""
    return F.split_part(c, F.lit("_"), F.lit(2))


def utt_partition(c: Column) -> Column:
    """SCL-60, second part."""
    return F.split_part(c, F.lit("_"), F.lit(3))


def recording_of(c: Column) -> Column:
    """SCL-61: without the last '_part'."""
    return F.regexp_replace(c, "_[^_]*$", "")


def audio_spec(c: Column) -> Column:
    """SCL-62: struct(path, start, frames) of 'path:start:frames'; nulls where it isn't one."""
    p = "^(.*):(\\d+):(\\d+)$"
    return F.struct(F.nullif(F.regexp_extract(c, p, 1), F.lit("")).alias("path"), F.regexp_extract(c, p, 2).try_cast("bigint").alias("start"), F.regexp_extract(c, p, 3).try_cast("bigint").alias("frames"))


def safe_filename(c: Column) -> Column:
    """SCL-63."""
    s = F.left(F.regexp_replace(strip(blank(c)), "[^A-Za-z0-9._-]+", "_"), F.lit(200))
    return F.when(s == "", "unknown").otherwise(s)


def textgrid_path(root: str, utt: Column) -> Column:
    """SCL-64, SNK-17, SNK-18: root/language/partition/utt.TextGrid."""
    return F.concat_ws("/", F.lit(root), utt_language(utt), utt_partition(utt), F.concat(utt, F.lit(".TextGrid")))


def latency_of_name(c: Column) -> Column:
    """SCL-65: low, medium, high or offline from a file name; null for others."""
    return F.nullif(F.regexp_extract(F.lower(c), "(low|medium|high|offline)(?:_latency)?\\.jsonl?$", 1), F.lit(""))


def flat_name(utt: Column, latency: Column) -> Column:
    """SNK-03: utt.json for offline, else utt_latency.json."""
    return F.when(latency == "offline", F.concat(utt, F.lit(".json"))).otherwise(F.concat(utt, F.lit("_"), latency, F.lit(".json")))


def used_utterance(path: Column, marker: str) -> Column:
    """SRC-20: the path part after ``marker``, without its extension."""
    parts = F.split(path, "/")
    return F.regexp_replace(F.try_element_at(parts, (F.array_position(parts, marker) + 1).cast("int")), "\\.[^.]*$", "")


def is_chat_model(c: Column) -> Column:
    """FLT-24."""
    return F.lower(c).rlike("-it\\b|instruct|chat")


def clean_future(observed: Column, raw: Column) -> Column:
    """SCL-32: cleaned model text, without the observed text it repeats; its first line."""
    t = clean_model_text(raw)
    rest = F.when(F.startswith(t, observed), F.regexp_replace(F.substr(t, F.length(observed) + 1), f"^{WS}+", "")).otherwise(t)
    return strip(F.split_part(rest, F.lit("\n"), F.lit(1)))


def distinct_futures(observed: Column, outputs: Column) -> Column:
    """SCL-79: first sentences of the cleaned continuations, the first of those equal but for case, without empty ones."""
    cut = F.filter(F.transform(outputs, lambda o: first_sentence(clean_continuation(observed, o))), lambda s: s != "")
    return F.get(F.transform(F.array(cut), lambda a: F.get(F.transform(F.array(F.transform(a, F.lower)), lambda low: F.filter(a, lambda _, i: F.array_position(low, F.get(low, i)) == i + 1)), 0)), 0)


def prediction(c: Column) -> Column:
    """FLT-34: a score as a number; what is missing or none raises."""
    return F.coalesce(c.try_cast("double"), F.raise_error(F.lit("no prediction")).cast("double"))
