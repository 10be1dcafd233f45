"""Both jobs over growing copies of the given tables: a later run takes what is new, a repeated run changes nothing."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import mine_patterns, search_report
from jobs.common import known
from motif.functions.tokens import token_hash

DATA = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain_patterns(batches, k):
    """Promotion one text at a time; each batch in order of ids."""
    seen, out = {}, set()
    for batch in batches:
        for i, text, lang, source in sorted(batch, key=lambda r: (r[0] is None, r[0])):
            places = seen.setdefault(token_hash(text), [])
            places.append((i, source, lang, text))
            if len(places) == k:
                out.add((token_hash(text), k, places[0][3], places[0][0], places[0][1], i, tuple(p[:3] for p in places), places[0][2]))
    return out


def found_patterns(spark, path):
    rows = mine_patterns.read(spark, path).collect()
    out = {(r["key"], r["frequency"], r["text"], r["first_doc"], r["first_source"], r["kth_doc"], tuple(map(tuple, r["places"])), r["lang"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("threshold", [2, 3])
def test_patterns_over_growing_input(spark, tmp_path, threshold):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    parts = [rows[::2], rows[1::2] + rows[:5], [(None, None, None, None), (None, "", "en", "s"), (7, None, None, None), (1, "new 'x' 5", "en", 's"1')]]
    folder, out, state = (str(tmp_path / n) for n in ("documents.parquet", "patterns", "state"))
    wrote = 0
    for n in range(len(parts)):
        spark.createDataFrame(parts[n], mine_patterns.DOCUMENTS).coalesce(1).write.mode("append").parquet(folder)
        facts = mine_patterns.run(spark, folder, out, state, {"threshold": threshold})
        want = plain_patterns(parts[: n + 1], threshold)
        wrote += facts["wrote"]
        assert facts["read"] == len(parts[n]) and found_patterns(spark, out) == want and wrote == len(want)
        again = mine_patterns.run(spark, folder, out, state, {"threshold": threshold})
        assert again["read"] == again["wrote"] == 0 and found_patterns(spark, out) == want
    assert wrote
    langs = [r for r in os.listdir(out) if r.startswith("lang=")]
    assert len(langs) > 1


def test_patterns_of_a_single_file_and_of_small_batches(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    one = plain_patterns([[tuple(r) for r in docs.collect()]], 2)
    mine_patterns.run(spark, f"{DATA}/documents.parquet", str(tmp_path / "a"), str(tmp_path / "as"))
    assert found_patterns(spark, str(tmp_path / "a")) == one
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    facts = mine_patterns.run(spark, str(tmp_path / "in"), str(tmp_path / "b"), str(tmp_path / "bs"), {"files_per_batch": 1})
    assert facts["batches"] > 1 and {r[0] for r in found_patterns(spark, str(tmp_path / "b"))} == {r[0] for r in one}


def hits(spark, path):
    return sorted(map(tuple, search_report.read(spark, path).select("search", "rank", "score", "conv_id", "turn", "role", "excerpt").collect()))


def test_searches_over_growing_input(spark, tmp_path):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    folder, index, out = (str(tmp_path / n) for n in ("turns", "index", "hits"))
    config = {"searches": {"a": "the and of tion", "b": "la que", "none": "zzzz"}, "top": 5, "refit": 0.2}
    turns.where("turn < 3").write.parquet(folder)
    first = search_report.run(spark, folder, index, out, config)
    assert first["fitted"] and first["new"] == first["rows"] == turns.where("turn < 3").count() and 0 < first["wrote"] <= 10
    before = hits(spark, out)
    again = search_report.run(spark, folder, index, out, config)
    assert (again["new"], again["fitted"]) == (0, False) and hits(spark, out) == before
    # One more turn, of words that the features have: weighed under the same fit. A repeated row and rows without a number are no turns.
    more = [(5000, 1, "user", "the and of tion"), (5000, 1, "user", "the and of tion"), (5000, 1, "user", None), (None, 1, "user", "the"), (5001, None, None, "the")]
    spark.createDataFrame(more, "conv_id long, turn long, role string, text string").write.mode("append").parquet(folder)
    grown = search_report.run(spark, folder, index, out, config)
    assert (grown["new"], grown["fitted"]) == (1, False)
    assert ("a", 1, 1.0, 5000, 1, "user", "the and of tion") in hits(spark, out)
    turns.where("turn >= 3").write.mode("append").parquet(folder)
    last = search_report.run(spark, folder, index, out, config)
    assert last["fitted"] and last["rows"] == turns.count() + 1
    fresh = str(tmp_path / "fresh")
    search_report.run(spark, folder, f"{fresh}/index", f"{fresh}/hits", config)
    assert hits(spark, out) == hits(spark, f"{fresh}/hits")
    search_report.run(spark, folder, index, out, config | {"searches": {"b": "la que"}})
    assert {r[0] for r in hits(spark, out)} == {"b"}


def test_settings():
    assert known({"top": 3}, search_report.DEFAULTS)["top"] == 3
    with pytest.raises(ValueError, match="tpo"):
        known({"tpo": 3}, search_report.DEFAULTS)


def test_searches_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        facts = search_report.run(spark, str(tmp_path / "in"), str(tmp_path / "i"), str(tmp_path / "o"), {"searches": {"a": "the"}})
        assert facts["wrote"] == facts["rows"] == 0
    with pytest.raises(ValueError, match="more than"):
        search_report.run(spark, str(tmp_path / "in"), str(tmp_path / "i"), str(tmp_path / "o"), {"searches": {"a": "the"}, "top": 10**6})


def test_the_command_line(tmp_path):
    config = str(tmp_path / "c.json")
    with open(config, "w") as f:
        json.dump({"threshold": 2}, f)
    paths = {"input": f"{DATA}/documents.parquet", "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "state"), "config": config}
    command = [sys.executable, "-m", "jobs.mine_patterns", *[x for k, v in paths.items() for x in (f"--{k}", v)]]
    ran = subprocess.run(command, cwd=REPO, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"})
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert '"job": "mine_patterns"' in ran.stderr and '"read": 200' in ran.stderr
