"""Scalar functions as Column expressions; all run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from motif.schema import CATEGORIES, FILE_ENDINGS, LANGUAGES

# Words of JavaScript and TypeScript, and of a common library, that keep their names in token hashes.
KEYWORDS = (
    "function const let var return if else for while switch case break continue class extends import export default from async "
    "await try catch finally throw new this super typeof instanceof in of true false null undefined void delete yield static get "
    "set interface type enum implements abstract private protected public readonly as is keyof infer declare module namespace "
    "require React useState useEffect useCallback useMemo useRef useContext useReducer"
).split()
# What adds to the complexity of JavaScript and TypeScript.
BRANCHES = (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bswitch\b", r"\bcatch\b", r"\bcase\b", r"\?\?", r"\?\.", r"\btry\b", "&&", r"\|\|", r"\?(?!=)")
# Categories for words that models like to invent.
OTHER_CATEGORIES = {
    "ui_components": "data_transform", "ui": "data_transform", "components": "data_transform", "react": "data_transform",
    "frontend": "data_transform", "database": "io", "http": "api_client", "web": "api_client", "utils": "string_utils",
    "utility": "string_utils", "error_handling": "validation", "security": "auth",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(key: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def language_of(path: Column) -> Column:
    """The language of a path by its extension in any case; null for others."""
    return lookup(F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)), LANGUAGES, F.lit(None).cast("string"))


def glob_match(path: Column, pattern: str) -> Column:
    """Shell wildcards over the whole path; * crosses slashes."""
    parts = {"*": ".*", "?": "."}
    return path.rlike("(?s)^" + "".join(parts.get(c) or re.escape(c) for c in pattern) + "$")


def tokens_of(source: Column) -> Column:
    """Literals replaced by markers, then words and single signs."""
    marked = F.regexp_replace(source, "'[^']*'", "'STR'")
    marked = F.regexp_replace(marked, '"[^"]*"', '"STR"')
    marked = F.regexp_replace(marked, "`[^`]*`", "`STR`")
    marked = F.regexp_replace(marked, r"(?U)\b\d+\.?\d*\b", "NUM")
    return F.regexp_extract_all(marked, F.lit(r"(?U)[a-zA-Z_$][a-zA-Z0-9_$]*|\S"), F.lit(0))


def token_hash(source: Column) -> Column:
    """Structural hash of token sequences: names become numbers in order of first appearance."""
    is_name = lambda t: t.rlike("^[a-zA-Z_$]") & ~t.isin(KEYWORDS)
    numbered = lambda ts, ids: F.transform(ts, lambda t: F.when(is_name(t), F.concat(F.lit("_v"), F.array_position(ids, t) - 1)).otherwise(t))
    joined = let(tokens_of(source), lambda ts: let(F.array_distinct(F.filter(ts, is_name)), lambda ids: F.array_join(numbered(ts, ids), " ")))
    return F.substring(F.sha2(joined, 256), 1, 16)


def branch_complexity(source: Column) -> Column:
    out = F.lit(1.0)
    for pattern in BRANCHES:
        out = out + F.regexp_count(source, F.lit("(?U)" + pattern)).cast("double")
    return out


def signature(node_type: Column, name: Column, calls: Column) -> Column:
    """The first six calls, or kind and name where there are none."""
    return F.when(F.size(calls) > 0, F.array_join(F.slice(calls, 1, 6), " → ")).otherwise(F.concat(node_type, F.lit("::"), name))


def fuzzy_tokens(source: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(r"(?U)[a-zA-Z_]+|[^\s\w]"), F.lit(0))


def is_hook(name: Column) -> Column:
    return name.rlike(r"^use\p{Lu}")


def is_component(name: Column, text: Column) -> Column:
    return name.rlike(r"^\p{Lu}") & (F.contains(text, F.lit("<")) | F.contains(text, F.lit("jsx")) | F.contains(text, F.lit("React.createElement")))


def classify(name: Column, text: Column, raw_kind: Column) -> Column:
    """Hook, component, arrow_fn or function, in this order; raw_kind is the parser's name of the node."""
    arrow = F.contains(text, F.lit("=>")) & (raw_kind != "function_declaration")
    return F.when(is_hook(name), "hook").when(is_component(name, text), "component").when(arrow, "arrow_fn").otherwise("function")


def brackets_balanced(code: Column) -> Column:
    """Whether opening and closing brackets differ by one at most."""
    return F.abs(F.regexp_count(code, F.lit(r"[\{\(\[]")) - F.regexp_count(code, F.lit(r"[\}\)\]]"))) <= 1


def unescape_code(code: Column) -> Column:
    """Literal \\n and \\t become characters where none are real; escaped quotes become quotes."""
    for mark, real in (("\\n", "\n"), ("\\t", "\t")):
        code = F.when(F.contains(code, F.lit(mark)) & ~F.contains(code, F.lit(real)), F.replace(code, F.lit(mark), F.lit(real))).otherwise(code)
    return F.replace(F.replace(code, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))


def kebab(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit("-"))


def title(name: Column) -> Column:
    """Words of a snake-case name with capitals; letters after digits and signs start words too."""
    words = F.regexp_extract_all(F.lower(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(words, F.initcap), "")


def file_ending(language: Column) -> Column:
    return lookup(language, FILE_ENDINGS, F.lit("py"))


def maturity(frequency: Column) -> Column:
    return F.when(frequency >= 10, "mature").when(frequency >= 5, "established").otherwise("emerging")


def shorten(text: Column, n: int = 60) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def word_buckets(text: Column) -> Column:
    """The bucket of each word: its MD5 modulo 256, which is its last byte."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 31, 2), 16, 10).cast("int"))


def run_lengths(values: Column) -> Column:
    """Array of (value, n) of the distinct values of an array, in order; by sorting, so in n log n time within the row."""

    def lengths(v: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
        return let(first, lambda f: F.transform(f, lambda at, k: F.struct(F.get(v, at).alias("value"), (F.coalesce(F.get(f, k + 1), F.size(v)) - at).alias("n"))))

    return let(F.sort_array(values), lambda v: F.when(F.size(v) > 0, lengths(v)))


def hash_vector(text: Column) -> Column:
    """Counts of word buckets as 256 floats of unit length; all zero without words."""
    counted = let(word_buckets(text), lambda b: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(counted, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def length_of(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, length_a: Column | None = None, length_b: Column | None = None) -> Column:
    """The cosine of two vectors, zero with a zero vector; lengths that are known already need not be computed for each pair."""
    norm = (length_of(a) if length_a is None else length_a) * (length_of(b) if length_b is None else length_b)
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def composite_hash(names: Column) -> Column:
    """A key of a list of names that is the same in every process."""
    return F.concat(F.lit("composed_"), F.substring(F.sha2(F.array_join(names, "\u0001"), 256), 1, 8))


def prompt(kind: Column, language: Column, frequency: Column, contexts: Column, source: Column) -> Column:
    """What a language model is asked to turn a pattern into; the first 3000 characters of the source and three contexts."""
    task = F.when(kind == "composed", "Combine these functions into one reusable workflow.").when(language == "python", "Turn this Python code into one reusable, typed function.")
    task = task.otherwise("Turn this JavaScript or TypeScript code into one reusable, exported function or component.")
    seen = F.array_join(F.slice(contexts, 1, 3), "; ")
    fields = "skill_name, category, description, tags, code, usage_example, complexity, composes_with, parameters"
    return F.concat(
        task, F.lit("\nKind: "), kind, F.lit("\nLanguage: "), language, F.lit("\nObserved: "), frequency.cast("string"), F.lit(" times, in "), seen,
        F.lit(f"\nAnswer with one JSON object with the fields {fields}.\nCode:\n"), F.substring(source, 1, 3000),
    )


def normal_category(category: Column) -> Column:
    """A valid category: itself; else the longest valid one inside it, or the first that it is inside; else by word; else io."""
    low = F.regexp_replace(F.lower(category), "[/ -]", "_")
    out = lookup(low, OTHER_CATEGORIES, F.lit("io"))
    for c in sorted(CATEGORIES, reverse=True):
        out = F.when(F.contains(F.lit(c), low), c).otherwise(out)
    for c in sorted(CATEGORIES, key=lambda c: (len(c), [-ord(x) for x in c])):
        out = F.when(F.contains(low, F.lit(c)), c).otherwise(out)
    return F.when(category.isNull(), "io").when(category.isin(*CATEGORIES), category).otherwise(out)


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)
