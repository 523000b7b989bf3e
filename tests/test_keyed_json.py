"""Members of large JSON objects, against the parser of the standard library."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from setloom.sources import dictionaries, documents
from setloom.sources.keyed_json import members


def awkward(rng):
    return "".join(rng.choices(["a", "}", "{", '"', "\\", ",", ":", "é", "夜", "\n", " ", "[", "]", "\t"], k=rng.randrange(0, 9)))


@pytest.mark.parametrize("block", [1 << 20, 700, 150])
def test_members_in_any_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    want = {}
    for f, indent in (("one", None), ("two", 1), ("three", None)):
        doc = {"generatedAt": awkward(rng), "list": [{"x": {}}, 1]}
        for section in ("works", "empty", "artists"):
            doc[section] = {f"{awkward(rng)}#{i}": {"c": awkward(rng), "v": [awkward(rng) for _ in range(rng.randrange(3))], "n": {"deep": {"er": awkward(rng)}}} for i in range(0 if section == "empty" else 40)}
        (tmp_path / f"{f}.json").write_text(json.dumps(doc, ensure_ascii=f == "three", indent=indent) + ("\n" if f == "two" else ""), encoding="utf-8")
        want[f] = [(s, k, v) for s in ("works", "artists") for k, v in doc[s].items()]
    (tmp_path / "none.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = members(spark, str(tmp_path)).orderBy("path", "ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in rows:
        got.setdefault(r.path.split("/")[-1].removesuffix(".json"), []).append((r.section, r.key, json.loads(r.json)))
    assert got == want


def test_export_read_export_gives_equal_bytes(spark, tmp_path):
    kinds = "field string, ord long, id string, canonical string, series string, kind string, variants array<string>, approved boolean, confidence string"
    rng = random.Random(4)
    rows = [("work", i, f"e{i}", f"{awkward(rng)}*{i % 30}", rng.choice([None, "s"]), "work", [f"{awkward(rng)}+{i}", f"v{i}"], True, "high") for i in range(80)]
    works = spark.createDataFrame(rows, kinds)
    read = lambda p: "".join(r.value + "\n" for r in spark.read.text(p).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect())
    documents.write_pieces(documents.aliases_document(works, works.limit(0), "d")[0], f"{tmp_path}/one")
    text = read(f"{tmp_path}/one")
    (tmp_path / "aliases.json").write_text(text, encoding="utf-8")
    back = dictionaries.aliases(spark, str(tmp_path / "aliases.json"), "works")
    assert [r.raw for r in back.orderBy("ord").collect()] == list(json.loads(text)["works"])
    again = back.groupBy("canonical", "series", "kind", "variants").agg(F.min("ord").alias("ord")).select(F.lit("work").alias("field"), "ord", "canonical", "series", "kind", "variants", F.lit(True).alias("approved"), F.lit("high").alias("confidence"))
    documents.write_pieces(documents.aliases_document(again, again.limit(0), "d")[0], f"{tmp_path}/two")
    assert read(f"{tmp_path}/two") == text
    assert dictionaries.aliases(spark, str(tmp_path / "missing.json"), "works").count() == 0
    assert dictionaries.aliases(spark, str(tmp_path / "aliases.json"), "artists").count() == 0
