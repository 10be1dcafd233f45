"""The kept search index gives what scoring all rows gives, reads less, and takes changed rows without a new fit."""

import math
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from motif.api import Library
from motif.operators import search
from motif.operators.index import SearchIndex
from motif.plans import fixtures

QUERIES = [(0, "red blue"), (1, "green green stone"), (2, ""), (3, "unknown"), (4, "river"), (5, "red blue green stone river hill lake")]
WORDS = "red blue green stone river hill lake tree bird road moon star".split()


def rows_of(spark, n, seed, first=0):
    rng = random.Random(seed)
    rows = [(first + i, " ".join(rng.choices(WORDS, weights=[30, 20, *[3] * 10], k=rng.randint(0, 12)))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string")


def asked(spark):
    return spark.createDataFrame(QUERIES, "query int, text string")


def plain(weights, rows, idf, k):
    """Every row's score for every query, from the weights alone."""
    spark = rows.sparkSession
    q = search.weigh(asked(spark), "query", "text", idf).withColumnRenamed("weight", "qw")
    scores = {(r["query"], r["id"]): r["score"] for r in weights.join(q, "term").groupBy("query", "id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score")).collect()}
    out = []
    for n, _ in QUERIES:
        best = sorted((-scores.get((n, r["id"]), 0.0), r["id"]) for r in rows.collect())[:k]
        out += [(n, i, -s, rank) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 7, 400])
def test_results_equal_a_scoring_of_all_rows(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr("motif.operators.index.BLOCK", 2)
    rows = rows_of(spark, 300, 1)
    kept = SearchIndex(spark, str(tmp_path / "index"), "id")
    assert not kept.there()
    kept.fit(rows, "text")
    assert kept.there()
    model = search.TfIdf(rows, "id", "text")
    assert sorted(map(tuple, kept.search(asked(spark), k).collect())) == plain(model.weights, rows, model.idf, k)
    for n, text in QUERIES:
        if text:
            assert [(r["id"], r["score"]) for r in model.search(text, k).collect()] == [r[1:3] for r in sorted(map(tuple, kept.search(asked(spark), k).collect()), key=lambda r: r[3]) if r[0] == n]
            break
    if k == 1:
        assert any(r["scored"] < r["blocks"] / 2 for r in kept.reach(asked(spark), k).collect())


def test_a_fit_takes_the_words_of_a_text_once(spark, tmp_path):
    """A text is computed for its words and for its digest, not once more for each pass over the terms."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    rows = rows_of(spark, 50, 5).withColumn("text", F.udf(read, "string")("text"))
    n = SearchIndex(spark, str(tmp_path / "index"), "id").fit(rows, "text")
    assert seen.value <= 2 * 50 and n == 50


@pytest.mark.parametrize("features", [1, 5, 40, 500])
def test_features_are_the_most_frequent_words_and_pairs(spark, features):
    """Pairs that are as frequent as their first word, ties, odd signs and a null text; one by one in Python."""
    texts = ["zeta alpha zeta alpha", "zeta alpha", "red blue red blue red", "Ünï_1 ünï_1 x the of", "e\u0301te\u0301 e\u0301te\u0301-deux", None, "", "the", "a\U0001d4b3b \U0001d4b3\U0001d4b3", "alpha-beta beta", "green"] + [t for _, t in map(tuple, rows_of(spark, 60, 6).collect())]
    occurs, df = Counter(), Counter()
    for t in texts:
        marks = lambda c: c == "_" or unicodedata.category(c)[0] in "LNM"
        words = [w for w in "".join(c if marks(c) else " " for c in (t or "").lower()).split() if len(w) > 1 and w not in search.STOP_WORDS]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        occurs.update(terms)
        df.update(set(terms))
    best = sorted(occurs, key=lambda t: (-occurs[t], t.encode()))[:features]
    model = search.TfIdf(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", features)
    assert {r["term"]: r["idf"] for r in model.idf.collect()} == {t: pytest.approx(math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in best}
    assert all(r["n"] == pytest.approx(1) for r in model.weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect())


def test_upserts_replace_rows_under_the_same_fit(spark, tmp_path):
    rows = rows_of(spark, 60, 2)
    kept = SearchIndex(spark, str(tmp_path / "index"), "id")
    kept.fit(rows, "text")
    idf = search.TfIdf(rows, "id", "text").idf
    changed = rows.withColumn("text", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" moon star"))).when(F.col("id") == 1, F.lit("")).otherwise(F.col("text"))).unionByName(rows_of(spark, 5, 3, 1000))
    n = kept.upsert(changed, "text")
    assert 20 <= n <= 26 and kept.upsert(changed, "text") == 0 and kept.rows().count() == 65
    assert sorted(map(tuple, kept.search(asked(spark), 9).collect())) == plain(search.weigh(changed, "id", "text", idf), changed, idf, 9)
    again = changed.withColumn("text", F.when(F.col("id") == 0, F.lit("red")).otherwise(F.col("text")))
    assert kept.upsert(again, "text") == 1 and kept.grown() == pytest.approx((n + 1) / 60)
    assert sorted(map(tuple, kept.search(asked(spark), 9).collect())) == plain(search.weigh(again, "id", "text", idf), again, idf, 9)
    kept.fit(again, "text")
    model = search.TfIdf(again, "id", "text")
    assert kept.grown() == 0 and sorted(map(tuple, kept.search(asked(spark), 9).collect())) == plain(model.weights, again, model.idf, 9)


def test_a_generation_without_its_rows_does_not_count(spark, tmp_path):
    """What a run that was stopped has left is not read, and the next run writes over it."""
    rows = rows_of(spark, 40, 4)
    kept = SearchIndex(spark, str(tmp_path / "index"), "id")
    kept.fit(rows, "text")
    want = sorted(map(tuple, kept.search(asked(spark), 3).collect()))
    more = rows_of(spark, 10, 5, 500)
    kept._write(search.weigh(more, "id", "text", kept._read("features", 0)), more.withColumn("digest", F.lit("x")).where("false"), 10, 0, 1)
    assert sorted(map(tuple, kept.search(asked(spark), 3).collect())) == want
    assert kept.upsert(rows.unionByName(more), "text") == 10 and kept.rows().count() == 50


def test_empty_and_blank_rows(spark, tmp_path):
    kept = SearchIndex(spark, str(tmp_path / "a"), "id")
    kept.fit(spark.createDataFrame([(1, None), (2, ""), (3, "the of")], "id long, text string"), "text")
    found = sorted(map(tuple, kept.search(asked(spark), 2).collect()))
    assert found == sorted((q, i, 0.0, i) for q, _ in QUERIES for i in (1, 2))
    empty = SearchIndex(spark, str(tmp_path / "b"), "id")
    empty.fit(spark.createDataFrame([], "id long, text string"), "text")
    assert not empty.there() or empty.search(asked(spark), 2).count() == 0


def test_the_library_searches_its_index(spark, tmp_path):
    lib = Library(spark, str(tmp_path))
    lib.register(fixtures.skills(spark))
    before = [(r["skill_name"], r["score"]) for r in lib.search("load json page").collect()]
    lib.embed()
    assert lib.kept_index().there() and [(r["skill_name"], r["score"]) for r in lib.search("load json page").collect()] == before
    renamed = fixtures.skills(spark).where("skill_name = 'save_json'").withColumns({"skill_name": F.lit("store_page"), "description": F.lit("Keeps a page"), "crystallized_at": F.lit(9e9)})
    lib.register(renamed)  # a third of the library: it is fitted anew
    assert lib.kept_index().grown() == 0 and lib.kept_index().rows().count() == 4
    assert [(r["skill_name"], r["score"]) for r in lib.search("page").collect()] == [(r["skill_name"], r["score"]) for r in search.search(lib.skills(), "page").collect()]


def test_a_get_opens_one_file(spark, tmp_path):
    """Of a library of many skills only the folders asked for are read; legacy files and odd names are found all the same."""
    import json

    from motif.sources import files

    for k in range(300):
        (tmp_path / f"skill-{k}").mkdir()
        (tmp_path / f"skill-{k}" / "meta.json").write_text(json.dumps({"skill_name": f"skill_{k}", "category": "io", "description": "d", "code": "x = 1"}))
    (tmp_path / "any.meta.json").write_text(json.dumps({"skill_name": "old_one", "category": "auth"}))
    (tmp_path / "odd {x}").mkdir()
    (tmp_path / "odd {x}" / "meta.json").write_text(json.dumps({"skill_name": "odd {x}", "category": "io"}))
    lib = Library(spark, str(tmp_path))
    found = lib.get("skill_17")
    assert found.first()["skill_name"] == "skill_17" and found.first()["tags"] == [] and [f.split("/")[-2] for f in found.inputFiles()] == ["skill-17"]
    few = files.read_named(spark, str(tmp_path), ["skill_3", "skill_4", "skill_4"])
    assert {r["skill_name"] for r in few.collect()} == {"skill_3", "skill_4"} and len(few.inputFiles()) == 2
    assert lib.get("old_one").first()["category"] == "auth" and lib.get("odd {x}").count() == 1
    assert {r["skill_name"] for r in files.read_named(spark, str(tmp_path), ["old_one", "skill_5"]).collect()} == {"old_one", "skill_5"}
    assert lib.get("../skill-1").count() == lib.get("none").count() == files.read_named(spark, str(tmp_path), []).count() == 0
