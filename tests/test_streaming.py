"""Streams: saved files come again, a key is promoted once across batches and restarts."""

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from motif.functions import parse
from motif.operators import compositions, crystallize, patterns
from motif.plans import catalogue, fixtures
from motif.schema import Settings
from motif.storage import settings
from motif.streaming import changes, mining, promote
from watching import caught_up, look_of


def watching(spark, tmp_path, roots, name="seen", **options):
    """A stream of saves that gathers (name, source, language) of each micro-batch in order, and where it gathers them."""
    seen, found = [], changes.saves(spark, roots, parts=3, **options)
    gather = lambda df, n: seen.extend((os.path.basename(r["path"]), r["source"], r["language"]) for r in df.orderBy("event_seq", "path").collect())
    with settings(spark, mining.STORE):
        return found.writeStream.foreachBatch(gather).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="0 seconds").start(), seen


def test_saves_come_again_and_what_was_there_does_not(spark, tmp_path):
    code = tmp_path / "code"
    for d in ("build", "deep/er", "deep/node_modules"):
        (code / d).mkdir(parents=True)
        (code / d / f"{d[-1]}.py").write_text("inner")
    (code / "a.py").write_text("one")
    (code / "x.md").write_text("no")
    os.symlink(code, code / "loop")
    query, seen = watching(spark, tmp_path, [str(code), str(code / "deep"), f"{code}/"])
    try:
        caught_up(query)
        assert seen == []
        os.utime(code / "a.py", (1, 1))
        (code / "c.tsx").write_text("new")
        (code / "build" / "z.py").write_text("no")
        (code / "deep" / "er" / "r.py").write_bytes(b"in\xffner")
        caught_up(query)
        assert sorted(seen) == [("a.py", "one", "python"), ("c.tsx", "new", "tsx"), ("r.py", "inner", "python")] and seen[0][0] == "a.py"
        (code / "c.tsx").unlink()
        caught_up(query)
    finally:
        query.stop()
    del seen[:]
    # What is saved while nothing runs is found afterwards; a path that went is new when it comes again.
    (code / "c.tsx").write_text("again")
    os.utime(code / "c.tsx", (2, 2))
    query, seen = watching(spark, tmp_path, [str(code), str(code / "deep")])
    try:
        caught_up(query)
        assert seen == [("c.tsx", "again", "tsx")]
        assert look_of(query.lastProgress["sources"][0]["endOffset"]) < time.time() * 1e6
    finally:
        query.stop()


def test_a_burst_of_saves_is_one_event(spark):
    """Looks at 1, 2, .. seconds with a pause of two: what each look tells, by the operator alone."""

    class Handle:
        value = None

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    def told(looks, **options):
        step, out = changes.Snapshot(**options), []
        step.init(Handle())
        for second, there in enumerate(looks, 1):
            rows = [(0, p, float(t), second * 10**6, second == 1) for p, t in [(None, 0), *there]]
            found = step.handleInputRows((0,), iter([pd.DataFrame(rows[:2], columns=COLUMNS), pd.DataFrame(rows[2:], columns=COLUMNS)]), None)
            out.append([(r.path, r.mtime) for b in found for r in b.itertuples()])
        return out

    COLUMNS = ["part", "path", "mtime", "look", "first"]
    looks = [[("a", 5)], [("a", 6), ("b", 1)], [("a", 7), ("b", 1)], [("a", 7), ("b", 1)], [("a", 7)], [("a", 7), ("b", 1)], [("a", 7), ("b", 1)], [("a", 7), ("b", 1), ("b", 1)]]
    assert told(looks, backfill=False, quiet=2.0) == [[], [], [], [("b", 1)], [("a", 7)], [], [], [("b", 1)]]
    assert told(looks, backfill=False, quiet=0.0) == [[], [("b", 1), ("a", 6)], [("a", 7)], [], [], [("b", 1)], [], []]
    assert told(looks[:2], backfill=True, quiet=0.0) == [[("a", 5)], [("b", 1), ("a", 6)]]
    assert told([[("a", 5)]] * 4, backfill=True, quiet=2.0) == [[], [], [("a", 5)], []]
    assert told([[], []], backfill=True, quiet=0.0) == [[], []]


def test_trees_are_shared_among_tasks_and_bad_roots_are_told(tmp_path, monkeypatch):
    for i in range(20):
        (tmp_path / f"d{i}" / "e").mkdir(parents=True)
        (tmp_path / f"d{i}" / "e" / "f.py").write_text("x")
        (tmp_path / f"d{i}" / "g.js").write_text("x")
    reader = changes.ListingReader([str(tmp_path)], 5, 0, 4)
    tasks = reader.partitions({"look": 0}, {"look": 7})
    rows = [list(reader.read(t)) for t in tasks]
    assert len(tasks) == 4 and min(len(r) for r in rows) > 3
    paths = [r[1] for part in rows for r in part if r[1]]
    assert len(paths) == len(set(paths)) == 40 and set(paths) == {p for p, _ in changes.list_tree(str(tmp_path))}
    assert sorted(r[0] for part in rows for r in part if not r[1]) == [0, 1, 2, 3, 4] and all(r[3:] == (7, True) for part in rows for r in part)
    assert reader.partitions({"look": 7}, {"look": 7}) == []
    # A tree in which nothing changes is looked at once; one beyond the driver's bound by every second trigger.
    first = reader.latestOffset()
    assert reader.latestOffset() == first == reader.latestOffset()
    (tmp_path / "d3" / "g.js").unlink()
    second = reader.latestOffset()
    assert second["look"] > first["look"] and reader.latestOffset() == second
    monkeypatch.setattr(changes, "GLANCED", 10)
    third = reader.latestOffset()
    assert third["look"] > second["look"] and reader.latestOffset() == third and reader.latestOffset()["look"] > third["look"]
    with pytest.raises(FileNotFoundError):
        changes.ListingReader([str(tmp_path / "none")], 5, 0, 4)


def run(spark, source, out, state, k=2):
    schema = "key string, seq long, source string, context string"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    q = promote.promote_stream(events, k).writeStream.outputMode("append").format("json").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r["key"], r["frequency"], r["source"], r["contexts"]) for r in spark.read.schema(promote.OUTPUT).json(out).collect())


def test_promotes_once_across_batches_and_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def add(n, rows):
        spark.createDataFrame(rows, "key string, seq long, source string, context string").coalesce(1).write.mode("append").json(source)

    add(1, [("a", 1, "s1", "c1"), ("b", 2, "t1", "c1")])
    assert run(spark, source, out, state) == []
    add(2, [("a", 3, "s2", "c2"), ("a", 4, "s3", "c3")])
    want = [("a", 2, "s1", ["c1", "c2"])]
    assert run(spark, source, out, state) == want
    add(3, [("a", 5, "s4", "c4"), ("b", 7, "t3", "c3"), ("b", 6, "t2", "c2")])
    assert run(spark, source, out, state) == [*want, ("b", 2, "t1", ["c1", "c2"])]


def test_stream_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    a = sorted((r["user_id"], r["kth_event"], r["types"]) for r in catalogue.stream_promote(spark, d).collect())
    b = sorted((r["user_id"], r["kth_event"], r["types"]) for r in catalogue.promote_events(spark, d).collect())
    assert a == b and a


def test_debounced_stream(spark, tmp_path):
    rows = [("p", "2024-01-01 00:00:00", 1), ("p", "2024-01-01 00:00:01", 2), ("p", "2024-01-01 00:00:09", 3), ("q", "2024-01-01 01:00:00", 4)]
    spark.createDataFrame(rows, "path string, ts string, n long").select("path", F.col("ts").cast("timestamp").alias("ts"), "n").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp, n long").parquet(str(tmp_path / "in")).withWatermark("ts", "1 second").withColumnRenamed("n", "value")
    q = promote.debounce(stream, "path", "ts", "2 seconds").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]


def test_mining_saved_files(spark, tmp_path):
    code = tmp_path / "code"
    code.mkdir()
    seen = []
    q = mining.mine(changes.saves(spark, [str(code)], True), Settings(), lambda df, n: seen.extend(df.collect()), str(tmp_path / "state"), "0 seconds")
    try:
        (code / "a.py").write_text(fixtures.LOADER)
        caught_up(q)
        (code / "b.py").write_text(fixtures.TWIN)
        caught_up(q)
    finally:
        q.stop()
    assert len(seen) == 1 and [os.path.basename(c) for c in seen[0]["contexts"]] == ["a.py", "b.py"]


FIELDS = ["structural_hash", "source_code", "abstract_signature", "language", "frequency", "first_seen_file", "contexts", "complexity_score", "node_type", "decorators", "calls"]


def stream_of(spark, tmp_path, batches, wanted=Settings(), known=None, name="run"):
    """Candidates of a stream that gets each batch of (path, source) files in a micro-batch of its own."""
    source, out, state = (str(tmp_path / f"{name}-{n}") for n in ("in", "out", "state"))
    seq = 0
    for batch in batches:
        spark.createDataFrame([(seq + i, path, text) for i, (path, text) in enumerate(batch)], "event_seq long, path string, source string").coalesce(1).write.mode("append").parquet(source)
        seq += len(batch)
        found = mining.promoted(mining.file_units(spark.readStream.schema("event_seq long, path string, source string").parquet(source)), wanted, known)
        with settings(spark, mining.STORE):
            q = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.schema(found.schema).parquet(out)
    return sorted(str([r[f] for f in FIELDS]) for r in rows.collect())


def batch_of(spark, files, wanted=Settings()):
    units = parse.parse_files(spark.createDataFrame([(i, path, text) for i, (path, text) in enumerate(files)], "event_seq long, path string, source string"))
    found = patterns.candidates(units, wanted).select(*FIELDS)
    if wanted.detect_compositions:
        found = found.unionByName(crystallize.from_compositions(compositions.compositions(units, wanted.min_co_occurrence)).select(*FIELDS))
    return sorted(str([r[f] for f in FIELDS]) for r in found.collect())


SCRIPT = """export function useThing(id) {
  const [a, setA] = useState(id);
  if (a) { load(a); }
  while (a > 3) { setA(a - 1); }
  return a;
}
const Card = (props) => {
  if (props.x) { useThing(props.x); }
  for (const k of props.all) { show(k); }
  const n = props.all.length;
  return <div>{props.x}</div>;
};
"""
FILES = [*fixtures.PYTHON_FILES, *fixtures.PIPELINE_FILES, ("a/one.tsx", SCRIPT), ("b/two.tsx", SCRIPT.replace("props", "given")), ("bad.py", "def ("), ("c/three.tsx", SCRIPT)]
FILES = [f[-2:] for f in FILES]


def test_the_stream_finds_what_the_batch_finds(spark, tmp_path):
    """Kinds, signatures, calls, sets and chains, in one micro-batch and in one for each file."""
    want = batch_of(spark, FILES)
    assert any("'hook'" in r for r in want) and any("'component'" in r for r in want) and any("'composed'" in r for r in want)
    assert stream_of(spark, tmp_path, [FILES]) == want
    assert stream_of(spark, tmp_path, [[f] for f in FILES], name="single") == want


def test_settings_and_known_patterns_of_the_stream(spark, tmp_path):
    wanted = Settings(min_frequency=3, min_co_occurrence=3, detect_classes=False)
    assert stream_of(spark, tmp_path, [FILES[:5], FILES[5:]], wanted) == batch_of(spark, FILES, wanted)
    alone = Settings(detect_compositions=False)
    want = batch_of(spark, FILES, alone)
    # With the patterns of an earlier run as the initial state, and no checkpoint, none of them is given twice.
    hashes = [(r.split("'")[1],) for r in want]
    known = mining.known_to(spark.createDataFrame(hashes[:-1], "pattern_hash string"))
    assert stream_of(spark, tmp_path, [FILES[:6], FILES[6:]], alone, known, "known") == [r for r in want if r.split("'")[1] == hashes[-1][0]]


def test_settings_of_the_session_come_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with settings(spark, mining.STORE | {"motif.none": "1"}):
        assert spark.conf.get(key) != before and spark.conf.get("motif.none") == "1"
    assert spark.conf.get(key) == before and spark.conf.get("motif.none", None) is None


def test_only_the_first_rows_of_a_key_are_sent_on(spark):
    rows = [("a", i) for i in range(50, 0, -1)] + [(None, 3), (None, 1), (None, 2), ("b", 9)]
    found = promote.first_of_each(spark.createDataFrame(rows, "key string, seq long").coalesce(1), 2, ["key"], ["seq"]).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [("a", 1), ("a", 2), (None, 1), (None, 2), ("b", 9)]))


def test_keys_that_share_a_row_of_state_are_promoted_each_by_itself(spark, tmp_path, monkeypatch):
    """Rows of state don't grow in number with the keys; null sources and a null key count as others."""
    monkeypatch.setattr(promote, "GROUPS", 2)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = [[(f"k{i % 40}" if i % 41 else None, part * 1000 + i, f"s{i}" if i % 3 else None, f"c{i}") for i in range(part, 100, 3)] for part in range(3)]
    want, seen = [], {}
    for rows in events:
        spark.createDataFrame(rows, "key string, seq long, source string, context string").coalesce(1).write.mode("append").json(source)
        found = run_any(spark, source, out, state, 3)
        for key, _, text, context in rows:
            seen.setdefault(key, []).append((text, context))
            if len(seen[key]) == 3:
                want.append((key, 3, seen[key][0][0], [c for _, c in seen[key]]))
        assert found == sorted(want, key=str)
    parts = spark.read.format("statestore").load(state)
    assert want and parts.count() <= 2


def run_any(spark, source, out, state, k):
    events = spark.readStream.schema("key string, seq long, source string, context string").json(source)
    q = promote.promote_stream(events, k).writeStream.outputMode("append").format("json").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(((r["key"], r["frequency"], r["source"], r["contexts"]) for r in spark.read.schema(promote.OUTPUT).json(out).collect()), key=str)
