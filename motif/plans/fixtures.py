"""Small inline tables for operators that need source code or model answers, with results derived by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motif.schema import SKILL

LOADER = '''def load_config(path: str) -> dict:
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return {}
    except ValueError as e:
        raise RuntimeError(path) from e
'''
TWIN = LOADER.replace("load_config", "read_settings").replace("path", "target").replace(" as f", " as handle").replace("load(f)", "load(handle)")
PYTHON_FILES = [
    (1, "a.py", LOADER),
    (2, "b.py", TWIN),
    (3, "c.py", "class A:\n    def m(self):\n        def inner():\n            return helper(1)\n        return inner()\n\ndef top():\n    return A().m()\n"),
    (4, "d.py", "def broken(:\n"),
    (5, "e.txt", "def nothing():\n    pass\n"),
    (6, "f.py", "   \n"),
]
SCRIPT_FILES = [
    (1, "a.ts", "export function useThing(a) {\n  return fetchIt(a);\n}\n"),
    (2, "b.jsx", "const Card = (props) => {\n  return <div>{format(props.x)}</div>;\n};\n"),
    (3, "c.js", "const add = (a, b) => a + b;\nfunction plain(x) {\n  return add(x, 1) + Math.max(x, 2);\n}\nclass Box {\n  open() { return plain(3); }\n}\n"),
    (4, "d.js", "const n = 5;\n// function no() {}\nconst s = 'function no2() {}';\n"),
]
PIPELINE_FILES = [
    (1, "x.py", "def a():\n    return b()\n\ndef b():\n    return c()\n\ndef c():\n    return 1\n"),
    (2, "y.py", "def a():\n    return b()\n\ndef b():\n    return c()\n\ndef c():\n    return 2\n"),
    (3, "z.py", "def again():\n    return again()\n\ndef other():\n    return 1\n"),
]
SNIPPETS = [
    (1, "def f(a):\n    return a + 1"),
    (2, "def g(b):\n    return b + 2"),
    (3, "def f(a: int):\n    return a + 1"),
    (4, "async def f(a):\n    return a + 1"),
    (5, "def f(a):\n    return a + 'x'"),
    (6, "def f(a) -> int:\n    return a.x"),
    (7, "def f(a) -> str:\n    return a.x"),
    (8, "def f(a) -> str:\n    return a.y"),
    (9, "def broken(:"),
    (10, "[x for x in y if x and z]"),
    (11, LOADER),
    (12, TWIN),
]
DECORATED_FILES = [
    (1, "a.py", "@cache\n@route('/x')\ndef f():\n    return 1\n\ndef g():\n    return 2\n"),
    (2, "b.ts", "@sealed\nclass Box {\n  open() { return 1; }\n}\n"),
]
RATIOS = [(1, "x y z", "x y w"), (2, "t i d e", "d i e t"), (3, "d i e t", "t i d e"), (4, "a b", "a b"), (5, "", "a"), (6, "", "")]
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
REKEYED = [
    ("h1", 1, WORDS),
    ("h2", 2, WORDS.replace("seven ", "7 ")),
    ("h3", 3, "nothing here is like the others at all"),
    ("h2", 4, WORDS.replace("seven ", "8 ")),
]
SKILLS = [
    ("load_json", "io", "Reads json", ["json", "file"], 12, "python"),
    ("save_json", "io", "Writes json", ["json", "file", "disk"], 5, "tsx"),
    ("fetch_page", "api_client", "Fetches a page", ["http"], 1, "rust"),
]
ANSWERS = [
    (1, '```json\n{"skill_name": "load_json", "category": "io", "code": "x = 1", "tags": ["a", "b"],}\n```'),
    (2, '{"skill": {"name": "fetch", "category": "http", "code": "line1\nline2", "tags": []}}'),
    (3, 'Here: {"skill_name": "tick", "category": "weird", "code": `a = "q"`}'),
    (4, "no object at all"),
    (5, '{"skill_name": "", "code": "x"}'),
    (6, '{"skill_name": "cut", "category": "cache", "code": "y = 2", "tags": ["z"] oops}'),
]


def files(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "event_seq long, path string, source string")


def answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANSWERS, "id long, raw string")


def snippets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SNIPPETS, "id long, code string")


def skills(spark: SparkSession) -> DataFrame:
    full = [(n, c, d, t, f"def {n}(): pass", f"{n}()", "simple", [], [], "h", f, ["a.py"], lang, "function", 1.0) for n, c, d, t, f, lang in SKILLS]
    return spark.createDataFrame(full, SKILL)
