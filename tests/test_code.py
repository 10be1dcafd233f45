"""Structural keys, parsers, promotion and compositions on code, with expectations derived by hand."""

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motif.functions import exprs, parse, pyast, tokens
from motif.operators import compositions, crystallize, fuzzy, patterns
from motif.plans import fixtures
from motif.schema import Settings


def same(a, b):
    return pyast.describe(a)[0] == pyast.describe(b)[0]


def test_python_keys_are_equal_for_renamed_copies_only():
    assert same(fixtures.LOADER, fixtures.TWIN)
    assert same("def f(a):\n    return a + 1", "def g(b):\n    return b + 2")
    assert same("def f() -> X:\n    pass", "def f() -> Y:\n    pass")
    assert not same("def f(a: int):\n    pass", "def f(a: str):\n    pass")
    assert not same("try:\n    x()\nexcept E as a:\n    pass", "try:\n    x()\nexcept E as b:\n    pass")
    assert not same("def f():\n    pass", "async def f():\n    pass")
    assert not same("def f(a):\n    return a.x", "def f(a):\n    return a.y")
    assert not same("def f(a):\n    return a + 1", "def f(a):\n    return a + 'x'")
    assert not same("f(a=1)", "f(b=1)")
    assert pyast.describe("def f(:")[0] == "" and pyast.describe("def f(:")[1] == 1.0


def test_python_complexity():
    assert pyast.describe(fixtures.LOADER)[1] == 4.0
    assert pyast.describe("[x for x in y if x and z]")[1] == 3.0
    assert pyast.describe("x = 1 if y else 2")[1] == 1.0


def test_own_decorators_are_not_part_of_a_unit():
    units = parse.python_units("@cache\ndef f():\n    @inner\n    def g():\n        pass\n")
    assert [u["name"] for u in units] == ["f", "g"] and units[0]["decorators"] == ["cache"]
    assert units[0]["source_code"].startswith("def f")
    plain = parse.python_units("def f():\n    @inner\n    def g():\n        pass\n")
    assert same(units[0]["source_code"], plain[0]["source_code"])


def script(spark, code, f):
    return spark.createDataFrame([(code,)], "s string").select(f(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("code", "want"), [("a ?? b", 4.0), ("if (a) {} else if (b) {}", 4.0), ("a?.b", 3.0), ("x ? y : z", 2.0), ("a && b || c", 3.0), ("for(;;){ while(1){} }", 3.0), ("a ?= b", 1.0)]
)
def test_script_complexity(spark, code, want):
    assert script(spark, code, exprs.branch_complexity) == want


def plain_hash_tokens(code):
    for q in "'\"`":
        code = re.sub(f"{q}[^{q}]*{q}", f"{q}STR{q}", code)
    code = re.sub(r"\b\d+\.?\d*\b", "NUM", code)
    ids, out = {}, []
    for t in re.findall(r"[a-zA-Z_$][a-zA-Z0-9_$]*|\S", code):
        if re.match("[a-zA-Z_$]", t) and t not in exprs.KEYWORDS:
            t = f"_v{ids.setdefault(t, len(ids))}"
        out.append(t)
    return " ".join(out)


def test_token_hash_equals_a_plain_loop_and_ignores_names(spark):
    import hashlib

    rng = random.Random(1)
    words = ["const", "x", "y1", "$a", "STR", "NUM", "'q r'", '"z"', "`t\nu`", "12", "3.5", "é", "(", ")", "=>", ";", "useState", "return", "\u3000"]
    codes = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, s string").select("i", exprs.token_hash(F.col("s"))).collect()
    for i, h in rows:
        assert h == tokens.token_hash(codes[i]) == hashlib.sha256(plain_hash_tokens(codes[i]).encode()).hexdigest()[:16], codes[i]
    a, b = "const total = add(price, 'x', 1);", "const sum = plus(cost, 'y', 22);"
    assert script(spark, a, exprs.token_hash) == script(spark, b, exprs.token_hash) != script(spark, a + ";", exprs.token_hash)


@given(st.text(alphabet="ab{}()[]'\"`/\\*\n ;=>x.", max_size=60))
def test_the_scanner_takes_any_text(code):
    for unit in parse.script_units(code):
        assert unit["source_code"] in code and unit["n_lines"] >= 0
    assert len(parse.mask(code)) == len(code)


def test_scripts():
    code = "@dec({a: 1})\nexport class A extends B {\n  m() { return go(); }\n}\nexport default async function load(u) { const r = await fetch(`${u}/x`); return r.json(); }\nlet k = 1, f = function () { return g(); };\nconst re = /function x() {/;\nconst gen = async x => { await h(x); };\n"
    units = parse.script_units(code)
    assert [(u["name"], u["node_type"], u["exports"]) for u in units] == [("A", "class", True), ("load", "function", True), ("f", "function", False), ("gen", "arrow_fn", False)]
    assert units[0]["decorators"] == ["@dec({a: 1})"] and units[0]["calls"] == ["go"]
    assert units[1]["calls"] == ["fetch", "r.json"] and units[3]["calls"] == ["h"]
    assert units[2]["source_code"].startswith("let k = 1")


def units_of(spark, rows):
    return parse.parse_files(fixtures.files(spark, rows))


def test_promotion_of_code(spark):
    files = fixtures.PYTHON_FILES
    assert patterns.candidates(units_of(spark, files[:1])).collect() == []
    found = patterns.candidates(units_of(spark, files)).collect()
    assert len(found) == 1 and found[0]["frequency"] == 2 and found[0]["language"] == "python" and found[0]["contexts"] == ["a.py", "b.py"]
    assert found[0]["source_code"] == fixtures.LOADER.rstrip("\n")
    again = [(i, "a.py", fixtures.LOADER) for i in range(5)]
    found = patterns.candidates(units_of(spark, again)).collect()
    assert [(r["frequency"], r["contexts"]) for r in found] == [(2, ["a.py", "a.py"])]
    assert patterns.candidates(units_of(spark, files), Settings(min_lines=8)).collect() == []
    assert patterns.candidates(units_of(spark, files), Settings(min_complexity=5.0)).collect() == []
    assert patterns.candidates(units_of(spark, [(1, "x.ts", "const a = 1;")]), Settings(min_lines=1, min_frequency=1, min_complexity=0.0)).collect() == []


def test_classes_can_be_left_out(spark):
    code = "class A:\n    x = 1\n\n    def m(self):\n        if self.x:\n            return 1\n        return 2\n"
    kept = patterns.eligible(units_of(spark, [(1, "a.py", code)]), Settings(min_lines=1, min_complexity=1.0, detect_classes=False))
    assert [r["name"] for r in kept.collect()] == ["m"]


def test_self_recursion_is_no_chain_and_sources_are_kept(spark):
    found = {r["name"]: r for r in compositions.compositions(units_of(spark, fixtures.PIPELINE_FILES)).collect()}
    assert set(found) == {"a_and_b_and_c", "b_to_c"}
    assert found["b_to_c"]["component_sources"] == ["def b():\n    return c()", "def c():\n    return 2"]
    assert len(found["a_and_b_and_c"]["component_sources"]) == 3
    skills = crystallize.from_compositions(compositions.compositions(units_of(spark, fixtures.PIPELINE_FILES)))
    assert {r["complexity_score"] for r in skills.collect()} == {5.0}


def test_chains_end_after_five_hops_and_do_not_loop(spark):
    code = "".join(f"def f{i}():\n    return m.f{(i + 1) % 8}() + f{i}()\n\n" for i in range(8))
    chains = {r["chain"][0]: r["chain"] for r in compositions.call_chains(units_of(spark, [(1, "a.py", code)])).collect()}
    assert chains["f0"] == ["f0", "f1", "f2", "f3", "f4", "f5"] and all(len(set(c)) == len(c) == 6 for c in chains.values())


def test_chains_by_joins_equal_those_in_a_row(spark):
    """Random units: names that repeat, calls that lead nowhere or back, none at all, and one name that most units call."""
    rng = random.Random(5)
    rows = []
    for f in range(6):
        for pos in range(rng.choice([1, 2, 25])):
            calls = None if rng.random() < 0.1 else [f"{rng.choice(['', 'a.', 'a.b.'])}{rng.choice(['hot', f'n{rng.randrange(15)}', 'out'])}" for _ in range(rng.randrange(12))]
            rows.append((f, f"f{f % 4}.py", pos, rng.choice([f"n{rng.randrange(15)}", "hot"]), calls, "function", "python", ""))
    units = spark.createDataFrame(rows, "event_seq long, path string, unit_pos int, name string, calls array<string>, node_type string, language string, source_code string")
    for depth in (1, 5):
        want = sorted(map(tuple, compositions.call_chains(units, depth).collect()))
        assert sorted(map(tuple, compositions.joined_chains(units, depth).collect())) == want and len(want) == len(rows)
    assert compositions.joined_chains(units.limit(0)).count() == 0


def test_similar_pairs_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(2)
    base = [" ".join(rng.choices("if x y foo ( ) ; = bar return".split(), k=rng.randint(0, 25))) for _ in range(12)]
    rows = list(enumerate(base + [b + " extra" for b in base]))
    tokens = {i: re.findall(r"[a-zA-Z_]+|[^\s\w]", s) for i, s in rows}
    want = {(i, j): SequenceMatcher(None, tokens[i], tokens[j]).ratio() for i in tokens for j in tokens if i > j and tokens[i] and tokens[j]}
    want = {p: round(r, 9) for p, r in want.items() if r > 0.85}
    found = fuzzy.similar_pairs(spark.createDataFrame(rows, "id long, s string"), "id", "s", 0.85).collect()
    assert {(r["new_id"], r["old_id"]): round(r["ratio"], 9) for r in found} == want and want


def test_rekeying(spark):
    rows = [("h1", 1, "a b c d e f g h"), ("h2", 2, "a b c d e f g h i"), ("h3", 3, "z y x"), ("h2", 4, "a b c d e f g h i")]
    found = fuzzy.rekey(spark.createDataFrame(rows, "structural_hash string, seq long, source_code string"), 0.85).collect()
    assert sorted((r["seq"], r["new_hash"]) for r in found) == [(1, "h1"), (2, "h1"), (3, "h3"), (4, "h1")]
    assert fuzzy.rekey_sequential([(h, s.split()) for h, _, s in rows], 0.85) == ["h1", "h1", "h3", "h1"]
    assert fuzzy.rekey_sequential([("a", ["x"]), ("b", [])], 0.0) == ["a", "b"]
