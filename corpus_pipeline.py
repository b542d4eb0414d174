"""The corpus pipeline: documents to packed training sequences, in five stages.

Whole documents pass through all but the last, so their tables run in sessions of their own, in which what a task
holds of long texts at once is bounded; the caller's settings stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import language
from glyphmill.llm.decontaminate import drop_contaminated
from glyphmill.llm.near_copies import drop_near_copies
from glyphmill.llm.packing import pack
from glyphmill.llm.shared import apart, drop_stored, store
from glyphmill.llm.suffix_dedup import remove_repeats
from glyphmill.sources.readers import spread


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null, empty and letterless texts, and those that score under
    `language.LEAST_SCORE` in every language that the documents' own labels teach.

    Repeated rows and rows without id are judged alike by their texts; where no language could be learned
    every text with a letter stays. All columns stay, whatever their names.
    """
    return apart(language.keep_identified(docs, language.fit(docs.select("doc_id", "text", "lang"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are similar to 4/5 or more the one with the smallest id stays.

    Candidates come from SimHash fingerprints over op2's index of byte positions; what it links is verified on the
    shingles themselves. Exactly one row of a group: ties go to the smaller text hash, then to the least row by all columns; rows
    without id come last. Null and wordless texts are one group.
    """
    return apart(drop_near_copies(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id also has are cut out of texts.

    Texts of which nothing is left go, rows without text stay; rows without id are never cut; texts of one
    id do not repeat each other.
    """
    return apart(remove_repeats(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; every row is judged on its own text, repeated rows alike.
    """
    return apart(drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their sequences and offsets.

    A null text is an empty one, which has the end mark alone; repeated rows are packed each for itself;
    pieces of equal length take planned places in any order.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), memory=50_000)  # earlier stages leave executors less room


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]
#: The language stage is a fitted model, which SQL cannot express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; every stage but the last is written to the shared folder and read again.

    What a stage read is deleted when its own rows are written.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        kept = store(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_stored(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
