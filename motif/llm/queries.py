"""The queries of this subpackage's operators, in the form that their contracts fix, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, hnsw, html, langid, lattice, packing, pii, resample, secrets, simhash, substrings, tokens
from .common import table
from .oracles import ORACLES as ORACLES


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.embedding_groups(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (code-point spans, comma-joined) and the text that is left."""
    cleaned = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_sentences", "n_removed", F.array_join("removed", ",").alias("removed"), "text")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs), ["doc_id"])
    return found.withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_column(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(table(spark, sf_dir, "documents"), tokens.tokenizer_path())


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), tokens.tokenizer_path())
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.media_features(table(spark, sf_dir, "documents"))
    return found.withColumn("seek_offsets", F.array_join(F.col("seek_offsets").cast("array<string>"), ","))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_texts(table(spark, sf_dir, "documents"), lattice.vocabulary_path(), learned=True)


QUERIES = {
    "op1_hnsw": op1_hnsw,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_substrings": op4_substrings,
    "op5_langid": op5_langid,
    "op6_html": op6_html,
    "op7_bpe": op7_bpe,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_audio": op10_audio,
    "op11_resample": op11_resample,
    "op12_lattice": op12_lattice,
}
