"""The library as a whole: learn from files, submit snippets, ask."""

import time

from motif.api import Library
from motif.plans import fixtures
from motif.schema import Settings
from motif.streaming.health import Health
from watching import caught_up


def test_learn_search_and_statistics(spark, tmp_path):
    lib = Library(spark, str(tmp_path))
    assert lib.skills().count() == 0 and lib.search("load").count() == 0
    lib.learn(fixtures.files(spark, fixtures.PYTHON_FILES))
    assert [r["skill_name"] for r in lib.list().collect()] == ["load_config"]
    assert lib.get("load_config").first()["page"].startswith("---\nname: load-config")
    assert lib.get("none").count() == 0 and lib.list("auth").count() == 0
    assert lib.search("config").first()["skill_name"] == "load_config"
    lib.learn(fixtures.files(spark, fixtures.PIPELINE_FILES))
    assert {r["category"] for r in lib.list().collect()} == {"io", "composed"}
    stats = lib.stats()
    assert stats["totals"].first()["n"] == lib.skills().count() == 3  # load_config, and one for each composition, named by its first function
    assert stats["languages"].first()["language"] == "python" and stats["top"].count() == 3
    assert lib.index().count() >= 4


def test_submitted_snippets(spark, tmp_path):
    lib = Library(spark, str(tmp_path), Settings(min_frequency=2))
    assert lib.submit([(fixtures.LOADER, "python", "")]).count() == 0
    seen = fixtures.files(spark, fixtures.PYTHON_FILES[:1])
    made = lib.submit([(fixtures.TWIN, "python", "mine")], seen)
    assert [(r["skill_name"], r["contexts"]) for r in made.collect()] == [("load_config", ["a.py", "mine.py"])]


def test_tool_server_answers_every_tool(spark, tmp_path):
    import io
    import json

    from motif.server import TOOLS, Server

    server = Server(Library(spark, str(tmp_path)))
    calls = [
        ("list_skills", {}), ("submit_code", {"code": fixtures.LOADER, "context": "one"}), ("submit_code", {"code": fixtures.TWIN}), ("submit_code", {"code": fixtures.TWIN}),
        ("get_skill", {"skill_name": "load_config"}), ("get_skill", {"skill_name": "none"}), ("search_skills", {"query": "config", "top_k": 1}), ("search_skills", {"query": "zzz"}),
        ("list_skills", {"category": "auth"}), ("list_skills", {}), ("get_skill_index", {}), ("get_stats", {}), ("nothing", {}), ("get_skill", {}),
    ]
    lines = [{"jsonrpc": "2.0", "id": 0, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"}]
    lines += [{"jsonrpc": "2.0", "id": 2 + i, "method": "tools/call", "params": {"name": n, "arguments": a}} for i, (n, a) in enumerate(calls)] + [{"id": 99, "method": "what"}]
    out = io.StringIO()
    server.serve(io.StringIO("\n".join(map(json.dumps, lines)) + "\nno json\n\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == len(lines) and {t["name"] for t in got[1]["result"]["tools"]} == set(TOOLS)
    texts = [x["result"]["content"][0]["text"] for x in got[2:-2]]
    assert texts[0] == "There are no skills yet." and texts[1].startswith("Noted") and texts[2].startswith("New skill `load_config`") and texts[3].startswith("Noted")
    assert "def load_config" in texts[4] and "no skill" in texts[5] and texts[6].startswith("`load_config`") and texts[7] == "Nothing fits."
    assert "no skills in `auth`" in texts[8] and "- `load_config`" in texts[9] and "load_config" in texts[10] and texts[11].startswith("1 skills")
    assert [x["result"]["isError"] for x in got[-4:-2]] == [True, True] and got[-2]["error"]["code"] == -32601 and got[-1]["error"]["code"] == -32700


def test_start_learns_from_saves_and_goes_on_after_a_restart(spark, tmp_path):
    from motif.streaming.agent import start

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text(fixtures.LOADER)
    lib = Library(spark, str(tmp_path / "skills"))
    for name, text, want in (("b.txt", "x", 0), ("b.py", fixtures.TWIN, 1)):
        running = start(lib, [str(tmp_path / "src")], str(tmp_path / "state"), backfill=True, period="100 milliseconds")
        caught_up(running)
        (tmp_path / "src" / name).write_text(text)
        caught_up(running)
        running.stop()
        assert lib.skills().count() == want
    assert lib.get("load_config").first()["language"] == "python"
    # Files that share a set of functions and a chain, while the miner runs; then again without its checkpoint.
    made = None
    for state in ("state", "lost"):
        running = start(lib, [str(tmp_path / "src")], str(tmp_path / state), backfill=True, period="100 milliseconds")
        for name, text in (("x.py", fixtures.PIPELINE_FILES[0][-1]), ("y.py", fixtures.PIPELINE_FILES[1][-1])):
            caught_up(running)
            (tmp_path / "src" / name).write_text(text)
        caught_up(running)
        running.stop()
        found = sorted((r["skill_name"], r["node_type"], r["crystallized_at"]) for r in lib.skills().collect())
        assert made is None or found == made
        made = found
    assert {"composed", "function"} <= {r[1] for r in made}


def test_init_retry_vectors_and_model_name(spark, tmp_path):
    import json

    import pytest

    from motif.__main__ import main
    from motif.operators import crystallize, search

    main(["--skills", str(tmp_path / "s"), "init", str(tmp_path)])
    made = json.loads((tmp_path / ".cursor" / "mcp.json").read_text())
    assert made["mcpServers"]["motif"]["args"][-1] == "mcp" and (tmp_path / ".vscode" / "mcp.json").exists()
    (tmp_path / ".cursor" / "mcp.json").write_text("{}")
    main(["--skills", str(tmp_path / "s"), "init", str(tmp_path)])
    assert (tmp_path / ".cursor" / "mcp.json").read_text() == "{}"
    waits, left = [], [1, 2]

    def work():
        if left:
            left.pop()
            raise ValueError
        return "done"

    assert crystallize.attempted(work, sleep=waits.append) == "done" and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        left += [1] * 9
        crystallize.attempted(work, sleep=waits.append)
    assert crystallize.active_model(Settings(backend="ollama", model="m")) == "ollama:m" and crystallize.active_model(Settings()) == "offline"
    lib = Library(spark, str(tmp_path / "s"))
    lib.learn(fixtures.files(spark, fixtures.PYTHON_FILES))
    lib.embed()
    assert abs(sum(r["weight"] ** 2 for r in lib.vectors().collect()) - 1) < 1e-4
    lib.learn(fixtures.files(spark, fixtures.PIPELINE_FILES))
    lib.embed()
    assert lib.vectors().select("skill_name").distinct().count() == 3 and lib.skills().count() == 3
    one = lib.get("load_config").withColumn("t", search.skill_text())
    assert search.query_vector(one, "skill_name", "t", "two words").count() == 2
    assert search.query_vector(lib.skills().withColumn("t", search.skill_text()), "skill_name", "t", "reusable form").count() >= 2


def test_answers_of_models_behind_http(monkeypatch):
    """Each backend's request and answer shape, and failures, against a server of our own."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib import request

    import pytest

    from motif.operators import crystallize

    asked = []

    class Fake(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body))
            text = "hi" if "fail" not in json.dumps(body) else None
            shape = {"response": text} if "/api/generate" in self.path else {"content": [{"text": text}]} if "/v1/messages" in self.path else {"candidates": [{"content": {"parts": [{"text": text}]}}]}
            self.send_response(200 if text else 500)
            self.end_headers()
            self.wfile.write(json.dumps(shape).encode())

        def log_message(self, *a):
            pass

    web = HTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    plain, base = request.Request, f"http://127.0.0.1:{web.server_port}"
    monkeypatch.setattr(request, "Request", lambda url, *a: plain(base + "/" + url.split("/", 3)[3], *a))
    for backend in ("ollama", "claude", "gemini"):
        assert crystallize.http_model(backend, "k", "m", base if backend == "ollama" else "")(["one", "fail", "two"]) == ["hi", None, "hi"]
    web.shutdown()
    assert [p for p, _ in asked[::3]] == ["/api/generate", "/v1/messages", "/v1beta/models/m:generateContent"]
    with pytest.raises(ValueError):
        crystallize.http_model("other")


def test_health_counts_batches(spark, tmp_path):
    health = Health()
    spark.streams.addListener(health)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("beat").format("noop").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if health.rows.get("beat"):
                break
            time.sleep(0.1)
        assert health.rows["beat"] == 5 and health.batches["beat"] >= 1 and not health.failed
    finally:
        spark.streams.removeListener(health)
