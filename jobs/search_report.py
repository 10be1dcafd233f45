"""Saved searches over conversations, answered from a kept index that each run brings up to date.

    python -m jobs.search_report --input conversations.parquet --index DIR --output DIR --config jobs/search_report.json

Input: Parquet turns (conv_id, turn, role, text); of rows that repeat conv_id and turn the one with the greatest text counts.
The first run fits the index. A later one weighs and adds only turns that are new or whose text changed, which it knows by the
digests in the index, and fits anew once `refit` times as many have come as the last fit had.

Output: Parquet by search: of each saved search the `top` turns with the greatest TF-IDF cosine above zero, with their rank,
score and an excerpt. It is written whole each time, so a run that is repeated gives the same rows, and a search that is no
longer in the config has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import known, main, report
from motif.functions import exprs
from motif.operators.index import SearchIndex
from motif.storage import kept as keep

DEFAULTS = {"searches": {}, "top": 10, "refit": 0.2}
#: Searches a run takes, and turns it reports of each: their product bounds what is sent to every task.
MOST = 10_000
HIT = "rank int, score double, conv_id long, turn long, role string, excerpt string, search string"


def turns(spark: SparkSession, input: str, some: DataFrame | None = None) -> DataFrame:
    """(id, conv_id, turn, role, text) of each turn, once; a null text is empty. Turns without a number can't be named and are left out.

    some (id), MOST rows at most: only these are looked for, before the copies of a turn are brought together.
    """
    rows = spark.read.schema("conv_id long, turn long, role string, text string").parquet(input).where("conv_id is not null and turn is not null")
    name = F.concat_ws(":", "conv_id", "turn").alias("id")
    if some is not None:
        rows = rows.select("*", name).join(F.broadcast(some.select("id").distinct()), "id", "left_semi")
    latest = F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "role")).alias("_t")
    return rows.groupBy("conv_id", "turn").agg(latest).select(name, "conv_id", "turn", "_t.role", "_t.text")


def run(spark: SparkSession, input: str, index: str, output: str, config: dict | None = None) -> dict:
    """One run; returns what it read and wrote."""
    wanted = known(config or {}, DEFAULTS)
    if len(wanted["searches"]) * wanted["top"] > MOST:
        raise ValueError(f"more than {MOST} rows to report")
    rows = turns(spark, input)
    kept = SearchIndex(spark, index, "id")
    if kept.there():
        new = kept.upsert(rows, "text")
        fitted = kept.grown() > wanted["refit"]
    else:
        new, fitted = None, True
    if fitted:
        n = kept.fit(rows, "text")
        new = n if new is None else new
    asked = spark.createDataFrame(sorted(wanted["searches"].items()), "query string, text string")
    hits = kept.search(asked, wanted["top"]).where("score > 0") if kept.there() else spark.createDataFrame([], "query string, id string, score double, rank int")
    hits = keep(hits, "hits")  # MOST rows at most
    found = turns(spark, input, hits).join(F.broadcast(hits), "id")
    found = found.select("rank", "score", "conv_id", "turn", "role", exprs.shorten(F.col("text")).alias("excerpt"), F.col("query").alias("search"))
    found.repartition("search").sortWithinPartitions("search", "rank").write.mode("overwrite").partitionBy("search").parquet(output)
    return report("search_report", input=input, new=new, fitted=fitted, index=index, rows=kept.rows().count() if kept.there() else 0, output=output, searches=len(wanted["searches"]), wrote=read(spark, output).count())


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(HIT).parquet(output)


if __name__ == "__main__":
    main("search_report", "Answers saved searches over conversations.", {"input": "conversations", "index": "the kept index", "output": "hits by search"}, run)
