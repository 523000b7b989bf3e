"""Comparison keys of titles, works and artists, as column expressions.

Spark has no Unicode normalisation, so `nfkc` is an Arrow UDF. Where a text is known to be normalised (ASCII tables, values
that were normalised on the way in), pass unicode=False and everything stays in the JVM.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters and words that the keys fold or cut at.
TILDES, DASHES, SINGLE_QUOTES, DOUBLE_QUOTES = "〜～", "‐‑‒–—―ー−", "’‘`´", "”“"
DROPPED = "・･,、.。/／\\|:：;；*＊☆★♡♪＿_+＋"
OPEN, CLOSE = "([{（【〔［", ")]}）】〕］"
BREAK_DASHES = "-‐‑‒–—―−"
REMIX = "remix|remixed|bootleg|boot|edit|mix|ver|version|cover|arrange|arranged|mashup|vip|extended|inst|instrumental"
REMIX_TAIL = "remixed|remix|bootleg|boot|edit|mix|ver|version|covered|cover|arranged|arrange|mashup|vip|extended|short|full|inst|instrumental|feat|ft"
NOTE_BRACKETS = "「」『』【】〔〕〈〉《》"
NOTE_PREFIXES = "TVアニメーション|TVアニメ|テレビアニメ|アニメ映画|劇場版アニメ|劇場版|映画|アニメ|ゲーム|TV"
NOTE_TAILS = r"(?<![A-Za-z])(?:OP|ED)\d*|第?\d+期|第\d+シーズン|シーズン\d+|SEASON\s*\d+|\d+年目\d*|収録楽曲|タイアップ楽曲|\d*周年楽曲|楽曲|ED?主題歌|主題歌|挿入歌|劇中曲|劇伴|テーマソング|キャラクターソング|キャラソン|イメージソング|劇場版|映画"
SERIES_MARKS = r"\d+期|\d+年目|シーズン\d*|season\s*\d*|\d+nd|\d+rd|\d+th|劇場版|映画|新編|続編|第\d+部|part\s*\d+|\d+"

KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
SPACE = r"(?U)[\s\x{FEFF}]"
_WORD = rf"(?<![A-Za-z0-9_])(?:{REMIX})(?![A-Za-z0-9_])"
_O, _C, _N = (f"[{''.join(chr(92) + c for c in x)}]" if i < 2 else f"[^{''.join(chr(92) + c for c in x)}]" for i, x in enumerate((OPEN, CLOSE, CLOSE)))
_GROUP = f"{_O}{_N}*{_C}"
_REMIX_GROUP = f"{_O}{_N}*?{_WORD}{_N}*{_C}"
_UNIT = f"(?:(?!{_GROUP}).|(?!{_REMIX_GROUP}){_GROUP})"
_DASH = f"[{''.join(chr(92) + c for c in BREAK_DASHES)}]"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else s if s.isascii() else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_each(texts: pd.Series) -> pd.Series:
    """All texts of an array in one call: a row crosses to Python once, however many cells it has."""
    one = lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s)
    return texts.map(lambda row: None if row is None else [one(s) for s in row])


def normalised(text: Column, unicode: bool) -> Column:
    return nfkc(text) if unicode else text


def norm_key(text: Column, unicode: bool = True) -> Column:
    """Key for comparing and searching: width, case, tildes, dashes and quotes folded, white space and marks dropped."""
    s = F.lower(normalised(text, unicode))
    s = F.translate(s, TILDES + DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + "！？" + DROPPED, "~" * len(TILDES) + "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "!?")
    return F.regexp_replace(s, SPACE, "")


def base_key(text: Column, unicode: bool = True) -> Column:
    """Key of the original: cut at a bracket or a spaced dash that announces a remix, other brackets and remix tails dropped.

    Under two characters left: the key of the whole text.
    """
    s = normalised(text, unicode)
    s = F.regexp_replace(s, rf"(?is)^(?:({_GROUP})({_UNIT}*?)|((?!{_GROUP}){_UNIT}+?)){_REMIX_GROUP}.*$", "$1$2$3")
    for _ in range(4):  # nested brackets, innermost first
        s = F.regexp_replace(s, _GROUP, " ")
    s = F.regexp_replace(s, rf"(?is)^(.+?)(?=(?:(?U:\s){_DASH}|{_DASH}(?U:\s)).*?{_WORD}).*$", "$1")
    s = F.regexp_replace(s, rf"(?i)(?U:[-_\s])*(?<![A-Za-z])(?:{REMIX_TAIL})(?![A-Za-z0-9_])[^\n\r\u2028\u2029]*\z", " ")
    key = norm_key(s, unicode=False)
    return F.when(F.length(key) >= 2, key).otherwise(norm_key(text, unicode))


def agg_key(text: Column, unicode: bool = True) -> Column:
    """Key for gathering candidates: letters and numbers only, small, katakana as hiragana; the long-vowel mark stays."""
    s = F.translate(F.lower(normalised(F.coalesce(text, F.lit("")), unicode)), KATAKANA, HIRAGANA)
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def strip_notes(text: Column) -> Column:
    """A work's name without brackets, media prefixes and notes such as openings and seasons, as far as two characters stay.

    One round takes one prefix and one tail. Six rounds do for nearly all names; where the seventh still changes one, rounds go
    on, at most once a character.
    """
    whole = F.coalesce(text, F.lit(""))
    start = _trim(F.regexp_replace(F.translate(whole, NOTE_BRACKETS, ""), r"(?U)\s+", " "))
    prefix = rf"(?iuU)^\s*(?:{NOTE_PREFIXES})\s*"
    tail = rf"(?iuU)(?:{NOTE_TAILS})\s*$"

    def without(s: Column, pattern: str) -> Column:
        cut = _trim(F.regexp_replace(s, pattern, ""))
        return F.when(F.length(cut) >= 2, cut).otherwise(s)

    # the tail pattern ends at the end of the text, so it can match once only
    def rounds(s: Column, count: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), count), s, lambda x, _: without(without(x, prefix), tail))

    # inside a lambda a value is made once, however often it is named
    six = F.transform(F.array(rounds(start, F.lit(6))), lambda x: F.struct(x.alias("now"), without(without(x, prefix), tail).alias("then")))
    done = F.transform(six, lambda x: F.when(x["now"] == x["then"], x["now"]).otherwise(rounds(x["then"], F.greatest(F.length(x["then"]), F.lit(1)))))[0]
    return F.when(done != "", done).otherwise(_trim(whole))


def series_marks(text: Column) -> Column:
    """The sorted set of sequel marks in a name."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?iuU)({SERIES_MARKS})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def normalize_separators(text: Column, unicode: bool = True) -> Column:
    """An artist's name with one way of writing lists, featuring and voice credits."""
    s = F.regexp_replace(_trim(normalised(F.coalesce(text, F.lit("")), unicode)), r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"(?iU)\s*\(\s*CV\s*[:.、,]?\s*", "(CV:")
    s = F.regexp_replace(s, r"(?iU)\s*(?<![A-Za-z])(?:featuring(?![A-Za-z])|feat\.|ft\.|feat(?![A-Za-z])|ft(?![A-Za-z]))\s*", " feat. ")
    s = F.regexp_replace(s, r"(?U)\s*[、,，/／|｜･・]+\s*", "・")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\(\s+", "("), r"(?U)\s+\)", ")")
    return F.regexp_replace(s, "^[ ・]+|[ ・]+$", "")


def flat_key(text: Column) -> Column:
    """Case and blanks folded, nothing else."""
    return F.translate(F.lower(text), " 　", "")


def bigrams(key: Column) -> Column:
    """The set of character pairs; a shorter key is its own element."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substring(key, i, F.lit(2)))
    return F.when(F.length(key) < 2, F.array(key)).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


@F.pandas_udf(T.DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity; meant for the few pairs that cheaper conditions leave."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def narrow_script(text: Column) -> Column:
    """No character from U+3000 on."""
    return ~text.rlike(r"[\x{3000}-\x{10FFFF}]")


def may_match_partly(key: Column) -> Column:
    """Two characters, or one Han character."""
    return (F.length(key) >= 2) | key.rlike(r"^\p{IsHan}$")


def content_id(prefix: str, members: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.array_join(F.array_sort(members), "\n").cast("binary"), 256), 1, 8))


def where_hint(events: Column, djs: Column) -> Column:
    """First to last event and one DJ, as a place to look at."""
    low, high = F.array_min(events), F.array_max(events)
    span = F.when(low.isNull(), "").when(low == high, F.format_string("第%d回", low)).otherwise(F.format_string("第%d回〜第%d回", low, high))
    name = F.concat(F.coalesce(F.array_min(djs), F.lit("")), F.when(F.size(F.array_distinct(djs)) > 1, " ほか").otherwise(""))
    return F.array_join(F.filter(F.array(span, name), lambda x: x != ""), " ")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the ASCII characters, rounded up, and one for each other character."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return (F.ceil((F.length(text) - other) / 4) + other).cast("long")


def looks_japanese(text: Column, share: float = 0.04) -> Column:
    """At least `share` of the characters are hiragana."""
    hira = F.length(F.regexp_replace(text, r"[^\x{3041}-\x{309F}]", ""))
    return F.when(F.length(text) > 0, hira / F.length(text) >= share).otherwise(False)


def retry_after_seconds(text: Column) -> Column:
    """Seconds in texts such as 19m2.208s."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}(?![a-z])", 1).try_cast("double"), F.lit(0.0))
    return F.when(text.rlike(r"\d+(?:\.\d+)?[hms]"), part("h") * 3600 + part("m") * 60 + part("s"))
