"""Large JSON objects read back member by member, in parallel and in the order of their keys.

A document such as {"head": 1, "works": {"a": {...}, "b": {...}}, "artists": {...}} may be one long line. Spark's text source cuts
it at closing braces, and cuts large files into blocks wherever a brace stands near. Whether a piece begins inside a string, and how
deep, depends on all before it. So each block is read for both cases, inside a string and not, and a row a block says where
each case leads; the blocks are followed in order, which gives every one its true start; then each block is read again from there, and
its pieces are numbered by the member that they belong to. Pieces of one member are put together and parsed by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.operators.staging import staged

SIGN = re.compile(r'\\.|["{}\[\]]', re.S)
HEAD = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\{\s*$')
BLOCK = "path string, block long, open boolean, end_open boolean, depth int"
PIECE = "path string, block long, n long, member long, ends boolean, section string, text string"


def _read(text: str, inside: bool, depth: int) -> tuple[bool, int]:
    """Where a piece leads: whether it ends inside a string, and how deep."""
    for sign in SIGN.findall(text):
        if inside:
            inside = sign != '"'
        elif sign == '"':
            inside = True
        elif sign in "{[":
            depth += 1
        elif sign in "}]":
            depth -= 1
    return inside, depth


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, text): what stands up to each closing brace, in order within a block; the braces at the ends of files included."""
    cut = spark.read.option("lineSep", "}").text(path)
    return cut.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now: dict[tuple[str, int], list] = {}
    for part in parts:
        for path, block, text in zip(part["path"], part["block"], part["value"], strict=True):
            cases = now.setdefault((path, block), [(False, 0), (True, 0)])
            for k, (inside, depth) in enumerate(cases):
                cases[k] = _read(text + "}", inside, depth)
    rows = [(path, block, bool(k), *case) for (path, block), cases in now.items() for k, case in enumerate(cases)]
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCK.split(", ")])


def _starts(blocks: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """Each block's true start, by following the blocks of a file: a few rows a block of the file system."""
    known: dict[tuple[str, int], dict[bool, tuple[bool, int]]] = {}
    for r in blocks.toLocalIterator():
        known.setdefault((r.path, r.block), {})[r.open] = (r.end_open, r.depth)
    out, path, at = {}, None, (False, 0)
    for key in sorted(known):
        if key[0] != path:
            path, at = key[0], (False, 0)
        out[key] = at
        end, deeper = known[key][at[0]]
        at = (end, at[1] + deeper)
    return out


def _own(text: str, inside: bool, depth: int, level: int) -> tuple[str, str | None]:
    """(what of a piece stands in a section, the section's name if the piece opens it)."""
    start, section = 0 if depth >= level else None, None
    for sign in SIGN.finditer(text):
        c = sign[0]
        if inside:
            inside = c != '"'
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
            if depth == level:
                named = HEAD.search(text[: sign.end()]) if c == "{" else None
                start, section = sign.end(), named[1] if named else ""
        elif c in "}]":
            depth -= 1
            start = start if depth >= level else None
    return text[start:] if start is not None else "", section


def _members(starts: dict[tuple[str, int], tuple[bool, int]], level: int):  # noqa: ANN202
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict[tuple[str, int], tuple[bool, int, int, int]] = {}
        for part in parts:
            rows = []
            for path, block, text in zip(part["path"], part["block"], part["value"], strict=True):
                inside, depth, member, n = now.get((path, block), (*starts[path, block], 0, 0))
                after, deep = _read(text + "}", inside, depth)
                own, section = _own(text, inside, depth, level)
                ends = deep == level and not after  # the brace closes a member, or one that holds it was closed before
                if deep >= level or section is not None:
                    rows.append((path, block, n, member, ends, section, own + "}" if deep >= level else ""))
                now[path, block] = after, deep, member + ends, n + 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])

    return run


def members(spark: SparkSession, path: str, level: int = 2) -> DataFrame:
    """(path, section, ord, key, json) of the members, objects themselves, of the objects at depth `level` of JSON files; section: the
    key of the object that they stand in; ord: their order in the file. Members that are no objects come along with the next one that
    is, those after the last one don't; files without any give no rows."""
    pieces = _pieces(spark, path)
    starts = _starts(pieces.mapInPandas(_blocks, BLOCK))
    found = staged(pieces.mapInPandas(_members(starts, level), PIECE), "json-pieces")
    in_block = Window.partitionBy("path", "block").orderBy("n")
    blocks = found.groupBy("path", "block").agg(F.max(F.col("member") + F.col("ends").cast("long")).alias("made"), F.max_by("section", F.when(F.col("section").isNotNull(), F.col("n"))).alias("last"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = blocks.select("path", "block", F.coalesce(F.sum("made").over(before), F.lit(0)).alias("first"), F.last("last", True).over(before).alias("open_section"))
    whole = found.withColumn("section", F.last("section", True).over(in_block)).join(blocks, ["path", "block"]).where("text <> ''")
    whole = whole.select("path", F.coalesce("section", "open_section").alias("section"), (F.col("first") + F.col("member")).alias("ord"), F.struct("block", "n", "text").alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "")  # the pieces of one member
    each = whole.groupBy("path", "section", "ord").agg(F.regexp_replace(text, r"^[\s,]+", "").alias("text"))
    table = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>")
    return each.select("path", "section", "ord", F.explode(table).alias("key", "json"))
