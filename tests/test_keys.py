from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from setloom.functions import keys, values


def apply(spark, fn, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_agg_key(spark):
    pairs = [("アイカツ!", "アイカツ"), ("☆", "★"), ("ＴＨＥ　ＩＤＯＬＭ＠ＳＴＥＲ", "THE iDOLM@STER"), ("ボカロ", "ぼかろ")]
    a, b = (apply(spark, keys.agg_key, [p[i] for p in pairs]) for i in (0, 1))
    assert a == b
    x, y = apply(spark, keys.agg_key, ["ビート", "ビト"])
    assert x != y


def test_strip_notes(spark):
    cases = {"TVアニメ「Engage Kiss」 ED": "Engage Kiss", "アイカツ! 楽曲": "アイカツ!", "てーきゅう5期 主題歌": "てーきゅう", "ONE PIECE FILM RED": "ONE PIECE FILM RED", "OP": "OP", "劇場版 呪術廻戦 0": "呪術廻戦 0", "": "", "ゆるゆり 1期OP": "ゆるゆり"}
    assert apply(spark, keys.strip_notes, list(cases)) == list(cases.values())


def test_series_marks(spark):
    got = apply(spark, keys.series_marks, ["響け!ユーフォニアム3", "てーきゅう 2期", "劇場版 X Season 2", "X", None])
    assert got == [["3"], ["2期"], sorted(["劇場版", "season 2"]), [], []]


def test_separators(spark):
    cases = {"わか,ふうり,すなお from STAR☆ANIS": "わか・ふうり・すなお from STAR☆ANIS", "宮内れんげ (CV.小岩井ことり)": "宮内れんげ(CV:小岩井ことり)", "MYTH & ROID": "MYTH & ROID", "A feat.B": "A feat. B", "Daft Punk": "Daft Punk"}
    assert apply(spark, keys.normalize_separators, list(cases)) == list(cases.values())


@pytest.mark.parametrize(
    ("title", "base"),
    [
        ("PSI-missing -2011 remix-", "PSI-missing"), ("Tulip -TAKU INOUE Remix-", "Tulip"), ("Magia -dark trance mix-", "Magia"), ("Morning Arch - Natino Remix", "Morning Arch"),
        ("NEXT COLOR PLANET -TEKINA//remix-", "NEXT COLOR PLANET"), ("硝子ドール [TeddyLoid Remix]", "硝子ドール"), ("硝子ドール(deshino NRG Bootleg)im Yurima mix", "硝子ドール"),
        ("FOREVER LOST", "FOREVER LOST"), ("Won(*3*)ChuKissMe!", "Won ChuKissMe!"), ("Remix", "Remix"), ("(a remix) bee [VIP edit] c", "bee"), ("(a remix) b [VIP edit] c", "(a remix) b [VIP edit] c"),
    ],
)
def test_base_key(spark, title, base):
    got = spark.range(1).select(keys.base_key(F.lit(title)).alias("a"), keys.norm_key(F.lit(base)).alias("b")).first()
    assert got.a == got.b


def test_norm_key(spark):
    assert apply(spark, keys.norm_key, ["ＡＢＣ　ｄｅｆ！", "カー・ト〜", "a_b+c", None]) == ["abcdef!", "カ-ト~", "abc", None]


def test_small_functions(spark):
    row = spark.range(1).select(
        keys.jaccard(keys.bigrams(F.lit("abc")), keys.bigrams(F.lit("abd"))).alias("j"), keys.bigrams(F.lit("a")).alias("one"), keys.may_match_partly(F.lit("恋")).alias("han"), keys.may_match_partly(F.lit("ラ")).alias("kana"),
        keys.estimate_tokens(F.lit("abcdeあい")).alias("tokens"), keys.looks_japanese(F.lit("これはペンです")).alias("ja"), keys.looks_japanese(F.lit("VOCALOID ボカロ")).alias("en"), keys.retry_after_seconds(F.lit("try in 19m2.208s")).alias("wait"),
        keys.where_hint(F.array(F.lit(2), F.lit(5)), F.array(F.lit("b"), F.lit("a"))).alias("where"), keys.edit_ratio(F.lit("aiobahn"), F.lit("aiobarn")).alias("ratio"), keys.narrow_script(F.lit("あ")).alias("narrow"),
    ).first()
    assert row.asDict() == {"j": 1 / 3, "one": ["a"], "han": True, "kana": False, "tokens": 4, "ja": True, "en": False, "wait": 1142.208, "where": "第2回〜第5回 a ほか", "ratio": pytest.approx(6 / 7), "narrow": False}


def test_values(spark):
    assert apply(spark, values.clean, ["　x ", "N/A", "なし", "", None, "ＡＢ"]) == ["x", None, None, None, None, "AB"]
    assert apply(spark, values.to_int, ["1.0", "-3.7", "01_", "no", None, "第9回"]) == [1, -3, 1, None, None, 9]
    assert apply(spark, values.to_float, ["-121.60", "約 98", "x"]) == [121.6, 98.0, None]
    assert apply(spark, values.to_remix, ["○", "×", "https://x", "なし", "maybe", "無"]) == [True, False, True, None, None, False]
    none = F.lit(None).cast("string")
    got = spark.range(1).select(*[c.alias(k) for k, c in values.repaired(F.lit("work again"), F.lit("http://a"), F.lit("http://b"), none, none).items()]).first()
    assert got.url == "http://a" and got.is_remix == "http://a" and got.note == "http://b"
