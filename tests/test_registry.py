"""Answers of models, the registry, search, sources and sinks."""

import json
import math

import pytest
from pyspark.sql import functions as F

from motif.functions import exprs, llmjson
from motif.operators import crystallize, registry, search
from motif.plans import fixtures
from motif.schema import CANDIDATE, PARAMETERS, SKILL, Settings
from motif.sources import files, sinks


def skill(name, category="io", tags=("a",), frequency=1, language="python", description="Reads things", composes=(), parameters=(), at=1.0):
    return (name, category, description, list(tags), f"def {name}(): pass", f"{name}()", "simple", list(composes), list(parameters), "h", frequency, ["x.py", "y.py"], language, "function", at)


@pytest.fixture()
def skills(spark):
    rows = [
        skill("load_json", tags=("json", "file"), frequency=12, parameters=[("path", "str", None, "where")]),
        skill("save_json", tags=("json", "file"), description="Writes json to disk", composes=("load_json",)),
        skill("fetch_page", "api_client", ("http",), 5, "javascript", "Fetches a page"),
        skill("cache_page", "caching", ("http", "file"), 2, "tsx", "Caches a page"),
    ]
    return spark.createDataFrame(rows, SKILL)


def test_lenient_answers():
    assert llmjson.parse('{"a": 1}') == {"a": 1}
    assert llmjson.parse('text {"a": [1, 2,], } more') == {"a": [1, 2]}
    assert llmjson.parse('{"a": "x\ny\tz"}') == {"a": "x\ny\tz"}
    assert llmjson.parse('{"a": "c:\\dir"}') == {"a": "c:\\dir"}
    assert llmjson.parse("nothing") is None and llmjson.parse(None) is None and llmjson.parse("} {") is None
    assert llmjson.parse('{"code": `say "hi"\n`}') == {"code": 'say "hi"\n'}
    assert llmjson.unwrap({"result": {"name": "x", "code": "y"}, "code": ""}) == {"code": "y", "skill_name": "x"}


def test_answers_with_nulls_and_odd_types(spark):
    rows = [(1, None), (2, '{"skill_name": "a", "code": "b", "tags": "no list", "parameters": [{"name": "p", "default": 3}, 4], "category": 7}'), (3, "[1]")]
    found = llmjson.parse_answers(spark.createDataFrame(rows, "id long, raw string")).collect()
    assert len(found) == 1 and found[0]["tags"] == [] and found[0]["category"] == "io"
    assert found[0]["parameters"][0].asDict() == {"name": "p", "type": None, "default": "3", "description": None}


def test_crystallize_offline_and_failing_models(spark):
    rows = [("h1", "def LoadIt(a):\n    return a", "s", "python", 2, "a.py", ["a.py", "b.py"], 2.0, "function", [], [], None), ("h2", "const x = (", "s", "tsx", 2, "c.tsx", ["c.tsx"], 2.0, "arrow_fn", [], [], None)]
    found = spark.createDataFrame(rows, CANDIDATE)
    made = {r["pattern_hash"]: r for r in crystallize.crystallize(found, now=9.0).collect()}
    assert made["h1"]["skill_name"] == "load_it" and made["h1"]["code_valid"] and made["h1"]["crystallized_at"] == 9.0 and made["h1"]["frequency"] == 2
    assert made["h2"]["skill_name"] == "x" and made["h2"]["code_valid"]
    assert crystallize.crystallize(found, lambda prompts: [None] * len(prompts)).collect() == []
    with pytest.raises(ValueError, match="unknown backend"):
        crystallize.http_model("other")


def test_upsert_related_and_index(spark, skills):
    newer = spark.createDataFrame([skill("load_json", frequency=13, at=2.0)], SKILL)
    kept = registry.upsert(skills.unionByName(newer), "skill_name", "crystallized_at").where("skill_name = 'load_json'").collect()
    assert [r["frequency"] for r in kept] == [13]
    near = [(r["name"], r["related_name"], r["overlap"]) for r in registry.related(skills, "skill_name", "tags").orderBy("name", "rank").collect()]
    assert near == [("cache_page", "fetch_page", 1), ("cache_page", "load_json", 1), ("cache_page", "save_json", 1), ("fetch_page", "cache_page", 1), ("load_json", "save_json", 2), ("load_json", "cache_page", 1), ("save_json", "load_json", 2), ("save_json", "cache_page", 1)]
    text = "\n".join(r["text"] for r in registry.index_sections(skills).collect())
    assert "load_json --> save_json" in text and "| `path` | `str` | required | where |" in text and "> Related: `save_json`, `cache_page`" in text and "mature" in text
    assert [r["skill_name"] for r in registry.editor_rules(skills).collect()] == ["cache_page", "fetch_page", "load_json", "save_json"]


def test_skills_round_trip_through_files(spark, skills, tmp_path):
    sinks.write_tree(registry.skill_files(skills), str(tmp_path))
    page = (tmp_path / "load-json" / "SKILL.md").read_text()
    assert page.startswith("---\nname: load-json\n") and "# Load Json" in page and "## Parameters" in page
    assert (tmp_path / "fetch-page" / "scripts" / "fetch_page.js").read_text().startswith("// pattern: h\n")
    legacy = {"skill_name": "old_one", "category": "io", "code": "x"}
    (tmp_path / "old.meta.json").write_text(json.dumps(legacy))
    (tmp_path / "dup.meta.json").write_text(json.dumps({"skill_name": "load_json", "category": "auth"}))
    (tmp_path / "bad.meta.json").write_text("{nope")
    back = {r["skill_name"]: r for r in files.read_skills(spark, str(tmp_path)).collect()}
    assert set(back) == {"load_json", "save_json", "fetch_page", "cache_page", "old_one"}
    assert back["load_json"]["category"] == "io" and back["load_json"]["crystallized_at"] == 1.0
    assert back["old_one"]["language"] == "python" and back["old_one"]["frequency"] == 0 and back["old_one"]["tags"] == []
    escape = spark.createDataFrame([("../out.txt", "x")], "path string, content string")
    with pytest.raises(Exception, match="leaves the folder"):
        sinks.write_tree(escape, str(tmp_path))


def test_files_are_written_all_or_none(spark, tmp_path):
    def tree():
        return {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}

    def write(rows, parts, root):
        sinks.write_tree(spark.createDataFrame(rows, "path string, content string").repartitionByRange(parts, "path"), root)

    write([(f"d{i}/e/{i}.txt", f"{i}é") for i in range(20)] + [("top.txt", None)], 4, f"file://{tmp_path}")
    first = tree()
    assert len(first) == 21 and first["d7/e/7.txt"] == "7é" and first["top.txt"] == ""
    # One task of four fails after the others have written: neither a new nor a changed file is seen, and nothing waits.
    with pytest.raises(Exception, match="leaves the folder"):
        write([(f"d{i}/e/{i}.txt", "other") for i in range(30)] + [("z/../../out.txt", "x")], 4, f"file://{tmp_path}")
    assert tree() == first and not (tmp_path / "_waiting").exists() and not (tmp_path.parent / "out.txt").exists()
    # A link below the root that leads out of it is no way out either; a plain path does as well as an address.
    (tmp_path / "link").symlink_to(tmp_path.parent)
    with pytest.raises(Exception, match="leaves the folder"):
        write([("link/out.txt", "x")], 1, str(tmp_path))
    (tmp_path / "link").unlink()
    write([("d7/e/7.txt", "seven"), ("d7/new.txt", "n")], 2, str(tmp_path))
    write([], 1, str(tmp_path))
    assert tree() == first | {"d7/e/7.txt": "seven", "d7/new.txt": "n"} and not (tmp_path / "_waiting").exists()


def test_lost_attempts_leave_no_files(tmp_path):
    """What the task contract allows: an attempt that nobody names, an attempt repeated, a failed write of a fresh root."""
    from pyspark.sql import Row

    one = sinks.FilesWriter(str(tmp_path / "skills"))
    one.write(iter([Row(path="a.txt", content="lost"), Row(path="only-there.txt", content="lost")]))
    kept = one.write(iter([Row(path="a.txt", content="kept")]))
    other = sinks.FilesWriter(str(tmp_path / "skills"))
    other.write(iter([Row(path="b.txt", content="waits")]))
    one.commit([kept, None])
    assert [p.name for p in (tmp_path / "skills").glob("*.txt")] == ["a.txt"] and (tmp_path / "skills" / "a.txt").read_text() == "kept"
    assert (tmp_path / "skills" / "_waiting").exists()
    other.abort([None])
    assert [p.name for p in (tmp_path / "skills").iterdir()] == ["a.txt"]


def test_candidates_round_trip(spark, tmp_path):
    rows = [("h1", "code", "sig", "python", 2, "a.py", ["a.py", "b.py"], 2.0, "function", ["d"], ["c"], None)]
    sinks.write_tree(sinks.candidate_files(spark.createDataFrame(rows, CANDIDATE)), str(tmp_path))
    (tmp_path / "old.json").write_text('{"structural_hash": "h2", "contexts": ["x"]}')
    (tmp_path / "bad.json").write_text("{")
    back = files.read_candidates(spark, str(tmp_path))
    got = {r["structural_hash"]: r for r in back.collect()}
    assert set(got) == {"h1", "h2"} and got["h2"]["decorators"] == [] and got["h2"]["node_type"] == "function"
    assert [(r["structural_hash"], r["context"]) for r in files.occurrences(back).orderBy("structural_hash", "pos").collect()] == [("h1", "a.py"), ("h1", "b.py"), ("h2", "x")]


def test_search_modes(skills):
    names = lambda df: [(r["skill_name"], r["score"]) for r in df.collect()]
    assert names(search.search(skills, "JSON", mode="keyword")) == [("save_json", 1.8), ("load_json", 1.3)]
    assert names(search.search(skills, "  ")) == []
    found = names(search.search(skills, "fetches page", k=2))
    assert found[0][0] == "fetch_page" and found[0][1] > found[1][1]
    assert names(search.search(skills, "zebra", k=1)) == [("cache_page", 0.0)]
    assert names(search.search(skills.where("skill_name = 'load_json'"), "json"))[0][0] == "load_json"


def test_hash_vector(spark):
    import hashlib

    text = "Some words some more"
    got = spark.createDataFrame([(text,), ("",)], "t string").select(exprs.hash_vector(F.col("t")).alias("v")).collect()
    want = [0.0] * 256
    for w in text.lower().split():
        want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 256] += 1
    norm = math.sqrt(sum(x * x for x in want))
    assert got[0]["v"] == pytest.approx([x / norm for x in want], abs=1e-6) and got[1]["v"] == [0.0] * 256
    same = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in same.select(exprs.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_titles_balance_and_settings(spark, monkeypatch):
    row = spark.createDataFrame([("load_2d_map",)], "n string")
    assert row.select(exprs.title(F.col("n"))).first()[0] == "load_2d_map".replace("_", " ").title()
    assert row.select(exprs.brackets_balanced(F.lit("f(a[0]"))).first()[0] and not row.select(exprs.brackets_balanced(F.lit("((("))).first()[0]
    monkeypatch.setenv("MOTIF_MIN_LINES", "9")
    monkeypatch.setenv("MOTIF_DETECT_CLASSES", "false")
    monkeypatch.setenv("MOTIF_EXTENSIONS", ".py,.ts")
    got = Settings.from_environment()
    assert (got.min_lines, got.detect_classes, got.extensions) == (9, False, (".py", ".ts"))


def test_sources(spark, tmp_path):
    for name, data in (("a.py", b"x = 1\n"), ("b.JS", b"x"), ("sub/c.ts", b"let a;\xff"), ("node_modules/d.js", b"no"), ("e.txt", b"no")):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, [str(tmp_path), str(tmp_path) + "/"])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.py", "c.ts"]
    assert {r["source"] for r in files.decoded(found).collect()} == {"x = 1\n", "let a;"}
    events = files.as_events(files.decoded(found)).collect()
    assert {r["language"] for r in events} == {"python", "typescript"}
    old = spark.createDataFrame([("same", 1.0), ("touched", 1.0), ("gone", 1.0)], "path string, mtime double")
    now = spark.createDataFrame([("same", 1.0), ("touched", 2.0), ("new", 1.0)], "path string, mtime double")
    assert sorted(r["path"] for r in files.changed(now, old).collect()) == ["new", "touched"]
    assert files.changed(now, files.first_snapshot(spark)).count() == 3
    got = files.submissions(spark, [("x", "tsx", "here"), ("y", "cobol", "")]).collect()
    assert [(r["path"], r["source"]) for r in got] == [("here.tsx", "x"), ("manual_submission.py", "y")]
    assert fixtures.answers(spark).count() == 6 and PARAMETERS
