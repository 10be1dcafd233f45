"""The corpus pipeline: language ID, near-duplicates, repeated passages, personal data, packing.

Each stage works on all that its predecessor kept; all but the last return the columns of documents, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motif.llm import langid, packing, pii, simhash, substrings, tokens
from motif.llm.common import hide, materialize, release, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the stage's own input rejects go: too far from every language, or without a letter.

    So null, empty and blank texts go. Repeated rows stay, each by itself; an id may be missing. Without a labelled row every
    document goes, as no language is known. Columns of any name stay; an empty table gives no rows.
    """
    docs, restored = hide(docs)
    found = langid.predict(docs, langid.train(docs), docs.columns)
    return restored(found.where("not rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: texts linked by 0.8 of their five-word shingles.

    It is the one with the least id; of rows that repeat an id one stays. Null and wordless texts are one group. A row
    without an id can't be named and stays. An empty table gives no rows.
    """
    return simhash.deduplicate_similar(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of passages that an earlier document holds go; a document of which nothing is left goes.

    Texts are compared in the order of ids, missing ones last, then of a hash of the text. Rows that repeat both are one
    document. Null, empty and short texts stay as they are. An empty table gives no rows.
    """
    docs, restored = hide(docs)
    cleaned = substrings.remove_repeats(docs)
    return restored(substrings.with_length(cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"(?U)\S"))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows.

    No row goes: null texts stay null, empty ones empty, repeated rows stay, with equal results. An empty table gives no rows.
    """
    docs, restored = hide(docs)
    return restored(pii.redact(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    A null or empty text is the closing id alone. Rows with the same id, or without one, are documents of their own. Other
    columns don't matter. An empty table gives no rows.
    """
    return packing.pack(docs, tokens.tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packed_sequences),
]

#: SQL can't express the language model, the components or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir; each other stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        begun = written()
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(begun, keep=1)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
