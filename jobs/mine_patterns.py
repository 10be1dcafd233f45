"""Incremental mining of a growing folder of texts: what recurs, once, when it recurs.

    python -m jobs.mine_patterns --input DIR --output DIR --checkpoint DIR --config jobs/mine_patterns.json

Input: Parquet files of documents (doc_id, text, lang, source), or one such file. Each run takes the files that are new since
the checkpoint and then ends; files are expected to be added whole and left as they are. Texts that differ only in names,
numbers and quoted parts share a key. When a key has come `threshold` times, in the order of runs and inside a run in that of
doc_id, it is written, once: its first text, the language and source it was first seen with, and all places so far.

Output: Parquet by language. A run that is repeated, or stopped and started again, with the same checkpoint and output gives
the same rows. Counts of keys below the threshold are kept in the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import known, main, report
from motif.functions import tokens
from motif.storage import table_if_there
from motif.streaming.promote import promote_stream

#: files_per_batch: how many files a micro-batch takes at most; null takes all. With several batches a run's order is theirs.
DEFAULTS = {"threshold": 2, "files_per_batch": None}
DOCUMENTS = "doc_id long, text string, lang string, source string"
PLACE = "doc_id long, source string, lang string"
PATTERN = f"key string, frequency long, text string, first_doc long, first_source string, kth_doc long, places array<struct<{PLACE.replace(' long', ':long').replace(' string', ':string')}>>, lang string"
#: Orders documents without an id after all others.
LAST = 2**63 - 1


def patterns(documents: DataFrame, threshold: int) -> DataFrame:
    """Promoted patterns of a stream of documents, in the form of PATTERN."""
    place = F.to_json(F.struct(*[c.split()[0] for c in PLACE.split(", ")]), {"ignoreNullFields": "false"})
    events = documents.select(tokens.token_hashes("text").alias("key"), F.coalesce("doc_id", F.lit(LAST)).alias("seq"), F.col("text").alias("source"), place.alias("context"))
    found = promote_stream(events, threshold)
    places = F.transform("contexts", lambda c: F.from_json(c, PLACE))
    first, kth = F.element_at("places", 1), F.element_at("places", -1)
    return found.withColumn("places", places).select(
        "key", "frequency", F.col("source").alias("text"), first["doc_id"].alias("first_doc"), first["source"].alias("first_source"), kth["doc_id"].alias("kth_doc"), "places", first["lang"].alias("lang")
    )


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """One run over what is new; returns what it read and wrote."""
    wanted = known(config or {}, DEFAULTS)
    before = _rows(spark, output)
    reader = spark.readStream.schema(DOCUMENTS)
    if wanted["files_per_batch"]:
        reader = reader.option("maxFilesPerTrigger", int(wanted["files_per_batch"]))
    folder = input.rstrip("/")
    documents = reader.parquet(f"{folder[:-1]}[{folder[-1]}]")  # as a pattern, a single file is as good as a folder
    sink = patterns(documents, int(wanted["threshold"])).writeStream.outputMode("append").format("parquet").partitionBy("lang")
    query = sink.option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        batches = [p for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
    after = _rows(spark, output)
    return report("mine_patterns", input=input, batches=len(batches), read=sum(p["numInputRows"] for p in batches), output=output, wrote=after - before, patterns=after)


def read(spark: SparkSession, output: str) -> DataFrame:
    """The patterns that all runs into that output have found."""
    return spark.read.schema(PATTERN).parquet(output)


def _rows(spark: SparkSession, output: str) -> int:
    found = table_if_there(spark, output, PATTERN)
    return 0 if found is None else found.count()


if __name__ == "__main__":
    main("mine_patterns", "Finds recurring texts in what is new in a folder.", {"input": "documents", "output": "patterns", "checkpoint": "state between runs"}, run)
