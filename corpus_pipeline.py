"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, decontamination, tokenization, in this order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``docs`` has to be re-readable in the same order
(files): ``run`` writes every stage's rows to the shared folder and reads them again before the next.

Defined results of all stages: rows are told apart by their place, so null and repeated ids are allowed and stay; extra
columns, whatever their names, pass through all but the last stage; an empty table gives an empty one; texts are read
whole, however long. A null or empty text has no letter, so language ID drops it; a stage that is given one all the same
takes it for a text without words: near copies of each other in near-dedup, untouched by passage dedup and
decontamination, no pieces in tokenization. Repeated rows are repeats of each other where a stage looks for repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from setloom.llm import decontaminate, langid, near_copies, pieces, suffix_dedup
from setloom.llm.common import stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: those without a letter, and those below the calibrated threshold."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays, the one with the least doc_id."""
    return near_copies.drop_near_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand in another document too are cut from the texts; all documents stay."""
    return suffix_dedup.dedup(docs, length=None, passage=suffix_dedup.PASSAGE, words=suffix_dedup.PASSAGE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in verbatim benchmark windows go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as vocabulary pieces: doc_id, lang, source, ids, n_pieces, n_chars and decoded_sha256."""
    return pieces.tokenize(docs, ("doc_id", "lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The stages train models, sort suffixes and solve segmentations, which SQL cannot express; tests/llm holds the
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
