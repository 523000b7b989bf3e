"""Cells of set lists as typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from setloom.functions.keys import normalised

# Spellings of a missing value and of yes and no.
NULLISH = ["", "-", "‐", "―", "ー", "#ref!", "#n/a", "n/a", "なし", "未定"]
REMIX_TRUE = ["○", "◯", "〇", "o", "◎", "●", "yes", "y", "有", "あり", "remix", "true", "1"]
REMIX_FALSE = ["原曲", "×", "✕", "x", "no", "n", "無", "なし", "false", "0"]
#: White space by Unicode, what \\s is under (?U).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def clean(value: Column, unicode: bool | None = True) -> Column:
    """Normalised and trimmed; spellings of a missing value become null. unicode None: the value is clean already."""
    return value if unicode is None else but_nullish(clean_ends(normalised(value, unicode)))


def clean_ends(text: Column) -> Column:
    """Without white space at its ends, by characters: a pattern would walk through each text."""
    return F.btrim(text, F.lit(WHITE))


def but_nullish(text: Column) -> Column:
    return F.when(~F.lower(text).isin(NULLISH), text)


def to_int(value: Column, unicode: bool | None = True) -> Column:
    """A whole number, a decimal cut off, or the first run of digits."""
    s = clean(value, unicode)
    plain = F.regexp_extract(s, r"^(-?\d+)(?:\.\d+)?$", 1)
    return F.when(plain != "", plain.try_cast("int")).otherwise(F.regexp_extract(s, r"(\d+)", 1).try_cast("int"))


def to_float(value: Column, unicode: bool | None = True) -> Column:
    """The first number, without its sign."""
    return F.regexp_extract(clean(value, unicode), r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def is_url(value: Column, unicode: bool | None = True) -> Column:
    return F.coalesce(clean(value, unicode).rlike(r"(?i)^https?://"), F.lit(False))


def to_remix(value: Column, unicode: bool | None = True) -> Column:
    """Yes, no or unknown; a link in the column stands for yes."""
    s = clean(value, unicode)
    return F.when(F.lower(s).isin(REMIX_TRUE), True).when(F.lower(s).isin(REMIX_FALSE), False).when(s.rlike(r"(?i)^https?://"), True)


def repaired(url: Column, is_remix: Column, note: Column, artist: Column, source_work: Column, unicode: bool | None = True) -> dict[str, Column]:
    """The columns of a record whose link may stand in another column: the first link found moves to url.

    The column it was found in is blanked, unless that is the remix column.
    """
    own = is_url(url, unicode)
    found = [("is_remix", is_remix), ("note", note), ("artist", artist), ("source_work", source_work)]
    out, taken = {}, own
    moved = F.when(own, url)
    for name, column in found:
        here = ~taken & is_url(column, unicode)
        moved = F.when(here, clean(column, unicode)).otherwise(moved)
        out[name] = column if name == "is_remix" else F.when(~here, column)
        taken = taken | here
    return {"url": moved, **out}


CONFIDENCE = {"xlsx": "high", "manual": "medium", "txt": "medium", "master-db": "medium", "filename": "low"}


def confidence(source_kind: Column) -> Column:
    pairs = [x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(source_kind, F.lit(""))], F.lit("medium"))
