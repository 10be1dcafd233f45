"""Every registered query against its DuckDB oracle, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from jobs import queries as jobs
from motif.plans import catalogue

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
SQL = {"STRING": "VARCHAR", "NUMBER": None, "bool": "BOOLEAN"}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or v != v else [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in v] if isinstance(v, list) else v
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES | jobs.ORACLES))
def test_query_equals_oracle(spark, oracle, name):
    found = (catalogue.QUERIES | jobs.QUERIES)[name](spark, DATA)
    want = oracle.execute((catalogue.ORACLES | jobs.ORACLES)[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, map(tuple, found.collect())) == rows_of(columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_entry_module_works_without_the_optional_parts(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "motif.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert set(alone.queries()) == set(catalogue.QUERIES) | set(jobs.QUERIES) and set(alone.oracle_sql()) == set(catalogue.ORACLES) | set(jobs.ORACLES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 10


def test_results_do_not_depend_on_partitions(spark):
    from motif.operators import patterns
    from pyspark.sql import functions as F

    rows = [(i % 7, i) for i in range(200)]
    for k in (1, 3):
        found = []
        for n in (1, 5, 13):
            df = spark.createDataFrame(rows, "key long, seq long").repartition(n)
            found.append(sorted(map(str, patterns.promote(df, "key", ["seq"], k, {"a": F.col("seq")}, {"b": F.col("seq")}, {"all": F.col("seq")}).collect())))
        assert found[0] == found[1] == found[2] and len(found[0]) == 7


def test_nearest_compares_blocks_and_equals_plain_cosines(spark, monkeypatch):
    """Ties by key, missing, zero, short and not finite vectors, in blocks smaller than k and larger; no pair goes through an expression."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from motif.functions import exprs
    from motif.operators import search

    rng = random.Random(3)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(60)] + [(100 + i, [0.5, 0.5, 0.1]) for i in range(30)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, []), (203, [1.0, None, 0.0]), (204, [1.0, 2.0]), (205, [float("nan"), 1.0, 0.0]), (206, [float("inf"), 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    asked = frame.where("id % 10 = 0 or id > 190")
    pairs = asked.select(F.col("id").alias("query"), F.col("v").alias("q")).crossJoin(frame)
    pairs = pairs.select("query", "id", F.round(exprs.cosine(F.col("v"), F.col("q")), 6).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    want = sorted(map(str, pairs.withColumn("r", F.row_number().over(order)).where("r <= 5").drop("r").collect()))
    for rows_, queries in ((1024, 1000), (4, 3), (7, 100)):
        monkeypatch.setattr(search, "PACKED", rows_)
        monkeypatch.setattr(search, "MOST_QUERIES", queries)
        found = search.nearest(frame, asked, "id", "v", 5)
        assert sorted(map(str, found.collect())) == want
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan.lower()
