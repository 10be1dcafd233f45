"""Answers are kept by request: a second attempt, and a later run, ask nothing twice."""

import json
import os

import pytest

from motif.api import Library
from motif.operators import crystallize
from motif.plans import fixtures


def counting(path, fails=(), answer=None):
    """A model that appends every prompt it gets to a file of its process, and fails for prompts with a word of fails."""

    def model(prompts):
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{os.getpid()}", "a") as f:
            f.writelines(json.dumps(p) + "\n" for p in prompts)
        if answer:
            return answer(prompts)
        return [None if any(w in p for w in fails) else f"answer to {p}" for p in prompts]

    return model


def asked_of(path):
    return sorted(json.loads(line) for name in (os.listdir(path) if os.path.exists(path) else ()) for line in open(f"{path}/{name}"))


def test_each_prompt_is_asked_once(spark, tmp_path):
    log, seen = str(tmp_path / "log"), str(tmp_path / "seen")
    rows = spark.createDataFrame([(i, f"prompt {i % 7}") for i in range(20)] + [(50, "bad one")], "id long, prompt string")
    found = crystallize.answered(rows, counting(seen, ("bad",)), log, "m", at_once=2)
    assert {(r["id"], r["raw"]) for r in found.collect()} == {(i, f"answer to prompt {i % 7}") for i in range(20)}
    assert asked_of(seen) == sorted([f"prompt {i}" for i in range(7)] + ["bad one"])
    more = rows.unionByName(spark.createDataFrame([(60, "prompt new")], "id long, prompt string"))
    assert crystallize.answered(more, counting(seen), log, "m").count() == 22
    assert asked_of(seen) == sorted([f"prompt {i}" for i in range(7)] + ["bad one"] * 2 + ["prompt new"])
    crystallize.answered(rows.limit(1), counting(seen), log, "other model").collect()
    assert len(asked_of(seen)) == 11
    assert crystallize.answered(rows.limit(0), counting(seen), str(tmp_path / "none")).count() == 0


def test_answers_before_a_failure_stay(spark, tmp_path):
    log, seen = str(tmp_path / "log"), str(tmp_path / "seen")
    rows = spark.createDataFrame([(i, f"prompt {i}") for i in range(30)], "id long, prompt string")
    good = counting(seen)

    def breaks(prompts):
        if "prompt 17" in prompts:
            raise ConnectionError("down")
        return good(prompts)

    with pytest.raises(Exception, match="down"):
        crystallize.answered(rows, breaks, log, at_once=3)
    assert crystallize.answered(rows, good, log, at_once=3).count() == 30
    first = [p for p in asked_of(seen)]
    kept_before = spark.read.parquet(log).count()
    assert kept_before == 30 and len(set(first)) == 30 and len(first) < 40  # of the job that failed, other tasks' prompts at most


def test_only_failed_prompts_are_asked_again():
    waits, calls = [], []

    def model(prompts):
        calls.append(prompts)
        return ["ok" if prompts[0] != "late" or len(calls) > 4 else None]

    assert crystallize.patient(model, gap=0.5, sleep=waits.append)(["a", "late", "b"]) == ["ok", "ok", "ok"]
    assert [c[0] for c in calls] == ["a", "late", "b", "late", "late"] and waits == [0.5, 0.5, 2.0, 0.5, 4.0, 0.5]
    assert crystallize.patient(lambda p: [None], sleep=waits.append)(["x"]) == [None]


def test_the_library_asks_nothing_twice(spark, tmp_path):
    seen = str(tmp_path / "seen")
    lib = Library(spark, str(tmp_path / "skills"), model=counting(seen, answer=crystallize.offline))
    lib.learn(fixtures.files(spark, fixtures.PYTHON_FILES))
    assert len(asked_of(seen)) == 1 and lib.skills().count() == 1
    lib.learn(fixtures.files(spark, fixtures.PYTHON_FILES))
    assert len(asked_of(seen)) == 1 and lib.skills().count() == 1
    for _ in range(2):
        lib.submit([(fixtures.LOADER, "python", ""), (fixtures.TWIN, "python", "")])
    assert len(asked_of(seen)) == 2  # other contexts make another prompt
