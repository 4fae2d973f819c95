"""Text normalisation and punctuation as Column expressions (SCL-01..26, FLT-10..23, MTH-03..05, MTH-12).

White space is Unicode white space throughout, as WS spells it for Java; an empty token is never a word.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed character sets.
EN_SENT, ZH_SENT = ".?!", "。？！"
EN_CLAUSE, ZH_CLAUSE = ",;", "，；"
EN_COLON, ZH_COLON = ":", "："
ZH_CLOSERS = "”’\"')）】》」』〕】"
NO_SPACE_BEFORE, NO_SPACE_AFTER = ",.!?;:)]}\"'", "([{\"'"
CJK = "\\u4e00-\\u9fff"
CJK_WIDE = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff"
WS = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u001c-\\u001f]"
WS_NOT_SPACE = "[" + WS[1:].replace("\\s", "\\t\\n\\x0b\\f\\r")


def _set(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-&\"'" else c for c in chars) + "]"


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def collapse(c: Column) -> Column:
    """SCL-04: runs of white space as one space, trimmed; single spaces are left alone, as most are."""
    return F.trim(F.regexp_replace(blank(c), f"{WS_NOT_SPACE}{WS}*| {WS}+", " "))


def tokens(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(collapse(c), " "), lambda t: t != "")


def normalize(c: Column) -> Column:
    """SCL-01: lower case; what isn't a-z, 0-9, an apostrophe or a space is a space; collapsed. Null gives ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9' ]+", " "), " {2,}", " "))


def letters_only(c: Column) -> Column:
    """SCL-02: as ``normalize``, but digits and apostrophes go too."""
    return F.trim(F.regexp_replace(F.lower(blank(c)), "[^a-z]+", " "))


def normalize_lenient(c: Column) -> Column:
    """SCL-03: digit groups and hyphenated words are joined before normalising: 3,000 is 3000, covid-19 is covid19."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "(?<=\\d),(?=\\d{3}(?!\\d))", ""), "(?<=[a-z0-9])-(?=[a-z0-9])", "")
    return normalize(joined)


def word_tokens(c: Column) -> Column:
    """Tokens of the normalised text, none for ''."""
    return F.filter(F.split(normalize(c), " "), lambda t: t != "")


def one_word_stripped(c: Column) -> Column:
    """SCL-08: at most one word once seven punctuation marks are gone."""
    return ~F.regexp_replace(blank(c), "[.,?!:;\\-]", "").rlike(f"[^{WS[1:-1]}]{WS}+[^{WS[1:-1]}]")


def one_word(c: Column) -> Column:
    """SCL-09, FLT-33: at most one run of letters and digits, with an inner apostrophe."""
    return F.regexp_count(blank(c), F.lit("[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?")) <= 1


def count_chars(c: Column, chars: str) -> Column:
    """SCL-10."""
    return F.regexp_count(blank(c), F.lit(_set(chars)))


def punct_bucket(c: Column) -> Column:
    """SCL-11: sent, clause, colon or ''."""
    return F.when(c.rlike(f"^{_set(EN_SENT + ZH_SENT)}$"), "sent").when(c.rlike(f"^{_set(EN_CLAUSE + ZH_CLAUSE)}$"), "clause").when(c.rlike(f"^{_set(EN_COLON + ZH_COLON)}$"), "colon").otherwise("")


def trailing_punct(c: Column, chars: str) -> Column:
    """SCL-12: the mark at the end, before closers."""
    return F.regexp_extract(rstrip(blank(c)), f"({_set(chars)}){_set(ZH_CLOSERS)}*$", 1)


def leading_punct(c: Column, chars: str) -> Column:
    """SCL-13."""
    return F.regexp_extract(blank(c), f"^{WS}*({_set(chars)})", 1)


def insert_before_closers(c: Column, mark: Column) -> Column:
    """SCL-14: put ``mark`` at the end, before closers and white space."""
    tail = F.regexp_extract(c, f"({_set(ZH_CLOSERS)}*{WS}*)$", 1)
    return F.when(c == "", c).otherwise(F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(tail)), mark, tail))


def full_width_tail(c: Column) -> Column:
    """SCL-15: an ASCII mark at the end becomes full width if a Chinese character or mark stands before it."""
    ascii_, wide = ",.?!;:", "，。？！；："
    pattern = f"^(.*[{CJK}{ZH_SENT}{ZH_CLAUSE}{ZH_COLON}])({_set(ascii_)})({_set(ZH_CLOSERS)}*{WS}*)$"
    head, mark, tail = (F.regexp_extract(c, f"(?s){pattern}", k) for k in (1, 2, 3))
    return F.when((mark != "") & c.rlike(f"[{CJK}]"), F.concat(head, F.translate(mark, ascii_, wide), tail)).otherwise(c)


def punctuation_only(c: Column) -> Column:
    """SCL-23: what isn't a letter, digit, underscore, white space or apostrophe."""
    return F.regexp_replace(blank(c), f"[\\p{{L}}\\p{{N}}_']|{WS}", "")


def _glue(left: Column, right: Column) -> Column:
    first, last = F.substring(right, 1, 1), F.substring(left, -1, 1)
    tight = last.rlike(f"^{WS}$") | first.rlike(f"^{WS}$") | first.rlike(f"^{_set(NO_SPACE_BEFORE)}$")
    return tight, last.rlike(f"^{_set(NO_SPACE_AFTER)}$")


def _join_piece(acc: Column, piece: Column) -> Column:
    tight, opened = _glue(acc, piece)
    return F.when(piece == "", acc).when(acc == "", piece).when(tight | opened, F.concat(acc, piece)).otherwise(F.concat(acc, F.lit(" "), piece))


def join_pieces(a: Column) -> Column:
    """SCL-20: pieces joined with a space, but not before closing or after opening marks; empty pieces add nothing."""
    return strip(F.aggregate(F.transform(a, blank), F.lit(""), _join_piece))


def running_joins(a: Column) -> Column:
    """SCL-20 for every prefix of ``a``, in one fold."""
    joined = F.aggregate(F.transform(a, blank), F.array().cast("array<string>"), lambda out, p: F.concat(out, F.array(_join_piece(blank(F.try_element_at(out, F.lit(-1))), p))))
    return F.transform(joined, strip)


def append(prefix: Column, more: Column) -> Column:
    """SCL-21: a continuation; opening marks count for nothing here."""
    tight, _ = _glue(prefix, more)
    return F.when(prefix == "", more).when(more == "", prefix).when(tight, F.concat(prefix, more)).otherwise(F.concat(prefix, F.lit(" "), more))


def join_source(a: Column) -> Column:
    """AGG-07, AGG-41: with spaces, empty segments skipped."""
    return F.array_join(F.filter(a, lambda s: s != ""), " ")


def join_target(a: Column) -> Column:
    """AGG-42, SCL-22 without collapsing."""
    return F.array_join(a, "")


def nonspace_length(c: Column) -> Column:
    """MTH-03, MTH-12: characters that aren't white space."""
    return F.length(F.regexp_replace(blank(c), WS, ""))


def length_ratio(hyp: Column, ref: Column) -> Column:
    """MTH-04: NaN where either is empty."""
    h, r = nonspace_length(hyp), nonspace_length(ref)
    return F.when((h == 0) | (r == 0), F.lit(float("nan"))).otherwise(h / F.when(r != 0, r))


def length_ratio_words(hyp: Column, source: Column) -> Column:
    """MTH-05: characters of the hypothesis for each source word."""
    h, w = nonspace_length(hyp), F.size(tokens(source))
    return F.when((h == 0) | (w == 0), F.lit(float("nan"))).otherwise(h / F.when(w != 0, w))


def zh_sentence_flag(source: Column, target: Column, excess: int | None = None) -> Column:
    """FLT-10, FLT-11: reason for which the target's sentence ends don't fit the source's, or ''; ``excess`` None turns the third rule off."""
    en, zh = count_chars(source, EN_SENT), count_chars(target, ZH_SENT)
    rule = F.when((en >= 2) & (zh == 0), "no_target_sentence_end").when(F.abs(en - zh) >= 3, "sentence_end_gap")
    return (rule if excess is None else rule.when(zh - en >= excess, "target_excess")).otherwise("")


def chinese_ratio_ok(c: Column, least: float = 0.5) -> Column:
    """FLT-21."""
    return (F.length(blank(c)) > 0) & (F.regexp_count(blank(c), F.lit(f"[{CJK}]")) >= least * F.length(blank(c)))


def latin_heavy(c: Column, ratio: float = 0.30) -> Column:
    """FLT-22."""
    return F.regexp_count(blank(c), F.lit("[A-Za-z]")) > ratio * F.greatest(F.lit(1), F.length(blank(c)))


def valid_future(c: Column, banned: tuple[str, ...] = (), markup: bool = False) -> Column:
    """FLT-13..15: not empty, no Chinese; with ``banned`` fragments or ``markup`` marks refused as well."""
    ok = (blank(c) != "") & ~blank(c).rlike(f"[{CJK_WIDE}]")
    for b in banned:
        ok = ok & ~F.contains(F.lower(blank(c)), F.lit(b.lower()))
    return ok & ~blank(c).rlike("[*`]") if markup else ok


def mfa_bad_token(c: Column) -> Column:
    """FLT-25: a token with a digit, markup or nothing alphabetic."""
    return c.rlike("[0-9<\\[]") | ~c.rlike("[A-Za-z]")


def coalesce_text(*cols: Column) -> Column:
    """FLT-27, FLT-28, FLT-32: the first that is neither null, blank nor 'nan'."""
    return F.coalesce(*[F.when((strip(c) != "") & (F.lower(strip(c)) != "nan"), strip(c)) for c in cols])


def suspicious(c: Column) -> Column:
    """SCL-76: a replacement character anywhere, or an end that can't be a whole character."""
    return blank(c).rlike("\\uFFFD") | blank(c).rlike("[\\p{Mn}\\p{Mc}\\p{Me}\\p{Cc}\\p{Cs}\\u200d\\ufe0f]$")


def suspicious_tail(c: Column) -> Column:
    """FLT-36: the same over the last four characters."""
    return suspicious(F.substring(blank(c), -4, 4))


def chars_prefix(c: Column, n: int) -> Column:
    """SCL-26: the shortest prefix with ``n`` characters that aren't white space."""
    return F.regexp_extract(blank(c), f"(?s)^((?:{WS}*[^{WS[1:-1]}]){{{n}}})", 1) if n > 0 else F.lit("")


def composed(c: Column) -> Column:
    """Unicode NFC."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return F.when(c.rlike("^[\\x00-\\x7f]*$"), c).otherwise(nfc(c))


def normalize_zh(c: Column) -> Column:
    """SCL-06: composed, without white space."""
    return F.regexp_replace(composed(blank(c)), WS, "")


def clean_translation(c: Column) -> Column:
    """SCL-25: the first line without invisible characters, as ``normalize_zh``."""
    line = F.split_part(strip(blank(c)), F.lit("\n"), F.lit(1))
    return normalize_zh(F.regexp_replace(line, "[\\u200b-\\u200f\\u2060\\ufeff]", ""))


def sanitized_vote(c: Column) -> Column:
    """SCL-51: a vote's text without candidate labels, brackets and quotes in front."""
    t = F.regexp_replace(normalize_zh(c), "^(?:(?:候选[A-Z]|Candidate[A-Z]|[A-Z])[:：]|\\[[A-Z0-9]+\\]|[\"“”'`])+", "")
    return F.regexp_replace(t, "^[\"'“”`\\[\\]:：]+", "")


def punct_gap(source: Column, target: Column, threshold: int) -> Column:
    """FLT-12: sentence ends of source and target differ by more than ``threshold``."""
    return F.abs(count_chars(source, EN_SENT) - count_chars(target, ZH_SENT)) > threshold
