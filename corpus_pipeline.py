"""A corpus pipeline of the training-data operators: from `documents` to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of documents
(doc_id, text, lang, source, n_chars), the last one the packed pieces. All stages read very long texts whole, keep rows with null
or repeated ids apart, leave out columns besides those of documents whatever their names, and make an empty table of an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.common import read, staged
from setloom.llm.language import identify_language
from setloom.llm.mixing import mix_sources
from setloom.llm.packing import pack_sequences
from setloom.llm.simhash import one_of_each_group
from setloom.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRY = ("text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, those without a language under the one that the classifier tells; null and empty texts go.

    The classifier rejects no text for being told as another language than it says: it errs on short texts, and those are clean.
    """
    told = identify_language(docs, carry=CARRY).where("lang_pred <> 'und'")
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Rows are told apart by what they hold, so ids may be null or repeated. The row with the least id is kept, a null one last.
    Null texts and texts without words are alike; an empty table stays empty; columns besides those of documents go.
    """
    return one_of_each_group(docs, COLUMNS, width=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 256 bytes, or of 51 words in fewer bytes, that stand elsewhere too; one with nothing left goes.

    Of rows with equal texts all repeated bytes go from each; empty texts stay, null ones become empty.
    """
    out = remove_repeats(docs, length=256, gram=96, carry=("lang", "source"), keep_text=True, words=51)
    out = out.where("n_removed = 0 or length(trim(kept_text)) > 0")
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null and wordless texts have no size and go, a null source is one of its own."""
    mixed = mix_sources(docs, carry=("text", "lang", "n_chars"))
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mixed.withColumn("_times", times).where("_times > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "_times")).alias("_copy")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null or empty text is one piece of length 1."""
    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing)]

#: Classifiers, fingerprints, byte strings, dynamic programs and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
