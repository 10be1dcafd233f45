"""Tools for assistants: the library over JSON-RPC lines on standard input and output, answered with texts."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import IO

from pyspark.sql import functions as F

from motif.api import Library
from motif.functions import exprs
from motif.operators import registry
from motif.schema import CATEGORIES, FILE_ENDINGS

PROTOCOL = "2024-11-05"


def _schema(required: Iterable[str] = (), **fields: dict) -> dict:
    return {"type": "object", "properties": fields, "required": list(required)}


TEXT = {"type": "string"}
TOOLS = {
    "search_skills": ("Skills that fit a description, the best first.", _schema(["query"], query=TEXT, top_k={"type": "integer", "minimum": 1})),
    "get_skill": ("One skill's code.", _schema(["skill_name"], skill_name=TEXT)),
    "list_skills": ("All skills, or those of a category.", _schema(category=TEXT | {"enum": list(CATEGORIES)})),
    "get_skill_index": ("The index of the library.", _schema()),
    "submit_code": ("Hands in a piece of code; what comes often enough becomes a skill.", _schema(["code"], code=TEXT, context=TEXT, language=TEXT | {"enum": list(FILE_ENDINGS)})),
    "get_stats": ("Numbers about the library.", _schema()),
}


class Server:
    """Answers requests about one library. What was submitted is remembered as long as the server lives."""

    def __init__(self, library: Library):
        self.library = library
        self.submitted: list[tuple[str, str, str]] = []
        self.told: set[str] = set()

    def search_skills(self, query: str, top_k: int | None = None) -> str:
        found = self.library.search(query, top_k).collect()  # top_k rows
        entry = "`{skill_name}` ({score:.2f}): {description}\n  {category}, {complexity}; tags: {tags}\n  usage: {usage_example}"
        return "\n".join(entry.format(**r.asDict() | {"tags": ", ".join(r["tags"])}) for r in found) or "Nothing fits."

    def get_skill(self, skill_name: str) -> str:
        row = self.library.get(skill_name).select(registry.code_file().alias("code")).first()
        return row["code"] if row else f"There is no skill `{skill_name}`; list_skills tells which there are."

    def list_skills(self, category: str | None = None) -> str:
        line = F.format_string("- `%s`: %s (seen %d times)", "skill_name", "description", "frequency")
        rows = self.library.list(category).select("category", line.alias("line"), exprs.title(F.col("category")).alias("title")).collect()
        out, last = [], None
        for r in rows:
            out += [f"{r['title']}:"] * (r["category"] != last) + [r["line"]]
            last = r["category"]
        return "\n".join(out) or "There are no skills" + (f" in `{category}`." if category else " yet.")

    def get_skill_index(self) -> str:
        return "\n\n".join(r["text"] for r in self.library.index().collect()) or "The library is empty."

    def submit_code(self, code: str, context: str = "", language: str = "python") -> str:
        self.submitted.append((code, language, context))
        made = [r for r in self.library.submit(self.submitted).collect() if r["pattern_hash"] not in self.told]
        self.told |= {r["pattern_hash"] for r in made}
        return "\n".join(f"New skill `{r['skill_name']}`: {r['description']}" for r in made) or "Noted. It becomes a skill when it comes again."

    def get_stats(self) -> str:
        stats = {k: v.collect() for k, v in self.library.stats().items()}
        total = stats["totals"][0]
        out = [f"{total['n']} skills, {total['total_frequency']} observations"]
        out += [f"category {r['category']}: {r['n']}" for r in stats["categories"]] + [f"language {r['language']}: {r['n']}" for r in stats["languages"]]
        return "\n".join(out + [f"top `{r['skill_name']}`: {r['frequency']}" for r in stats["top"]])

    def answer(self, request: dict) -> dict | None:
        """The response to a request; None to a notification."""
        method, given = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "motif", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s) in TOOLS.items()]}
        elif method == "tools/call":
            result = self._call(given.get("name"), given.get("arguments") or {})
        else:
            return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": f"no method {method!r}"}}
        return {"jsonrpc": "2.0", "id": request["id"], "result": result}

    def _call(self, name: str | None, arguments: dict) -> dict:
        if name not in TOOLS:
            return {"content": [{"type": "text", "text": f"There is no tool {name!r}."}], "isError": True}
        missing = [k for k in TOOLS[name][1]["required"] if k not in arguments]
        unknown = [k for k in arguments if k not in TOOLS[name][1]["properties"]]
        if missing or unknown:
            return {"content": [{"type": "text", "text": f"Missing: {missing}; unknown: {unknown}."}], "isError": True}
        return {"content": [{"type": "text", "text": getattr(self, name)(**arguments)}], "isError": False}

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        """Until the input ends: a request on each line, a response on each line."""
        for line in lines:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
            except ValueError:
                response = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
            else:
                response = self.answer(request) if isinstance(request, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
            if response is not None:
                print(json.dumps(response), file=out, flush=True)
