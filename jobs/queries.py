"""The jobs as queries: each runs twice into one new folder, and what stands there after the second run is the result."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import mine_patterns, search_report
from motif.plans.oracles import HASHES, kept_search
from motif.storage import fresh_path


def _config(name: str) -> dict:
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())  # the file beside the code, not data


def job1_search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "job1")
    for _ in range(2):
        search_report.run(spark, f"{sf_dir}/conversations.parquet", f"{out}/index", f"{out}/hits", _config("search_report"))
    return search_report.read(spark, f"{out}/hits")


def job2_mine_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """places: the ids and sources in order, as text."""
    out = fresh_path(spark, "job2")
    for _ in range(2):
        mine_patterns.run(spark, f"{sf_dir}/documents.parquet", f"{out}/patterns", f"{out}/checkpoint", _config("mine_patterns"))
    place = F.transform("places", lambda p: F.concat_ws(":", p["doc_id"], p["source"]))
    return mine_patterns.read(spark, f"{out}/patterns").withColumn("places", F.array_join(place, ","))


QUERIES = {"job1_search_report": job1_search_report, "job2_mine_patterns": job2_mine_patterns}

_TURNS = """SELECT conv_id || ':' || turn AS id, true AS fitted, max(coalesce(text, '')) AS text, any_value(conv_id) AS conv_id, any_value(turn) AS turn, arg_max(role, coalesce(text, '')) AS role
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1"""
_SEARCHES = [(f"'{name}'", text) for name, text in _config("search_report")["searches"].items()]
ORACLES = {
    "job1_search_report": kept_search(_TURNS, _SEARCHES, _config("search_report")["top"])
    + """ SELECT rank, score, conv_id, turn, role, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS excerpt, query AS search FROM r JOIN turns USING (id) WHERE score > 0""",
    "job2_mine_patterns": f"""WITH {HASHES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY token_hash ORDER BY doc_id NULLS LAST) AS r FROM hashes)
        SELECT token_hash AS key, count(*) AS frequency, max(CASE WHEN r = 1 THEN text END) AS text, max(CASE WHEN r = 1 THEN doc_id END) AS first_doc, max(CASE WHEN r = 1 THEN source END) AS first_source,
        max(CASE WHEN r = 2 THEN doc_id END) AS kth_doc, string_agg(concat_ws(':', doc_id, source), ',' ORDER BY r) AS places, max(CASE WHEN r = 1 THEN lang END) AS lang
        FROM ranked WHERE r <= 2 GROUP BY token_hash HAVING count(*) = 2""",
}
