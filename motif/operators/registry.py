"""The registry of skills: upsert, statistics, lists, related skills, dependencies, and the rendered index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motif.functions import exprs
from motif.operators.related import related

# Badges by category and by language.
CATEGORY_BADGES = {
    "io": "💾", "parsing": "🔍", "api_client": "🌐", "data_transform": "🔄", "validation": "✅", "concurrency": "⚡", "caching": "🗄️", "string_utils": "📝",
    "filesystem": "📁", "networking": "🔌", "auth": "🔐", "testing": "🧪", "logging": "📋", "composed": "🧩",
}
LANGUAGE_BADGES = {"python": "🐍", "javascript": "📜", "jsx": "⚛️", "typescript": "📘", "tsx": "⚛️"}


def upsert(rows: DataFrame, key: str, newest: str, *ties: str) -> DataFrame:
    """Of each key the row with the greatest `newest`; ties decide among equals, greatest first."""
    order = Window.partitionBy(key).orderBy(F.desc(newest), *[F.desc(t) for t in ties])
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def merge_layouts(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """All new rows, and old rows whose key no new row has."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def languages_by_category(rows: DataFrame, category: str, language: str) -> DataFrame:
    return rows.groupBy(category).agg(F.array_join(F.array_sort(F.collect_set(language)), ",").alias("languages"), F.count("*").alias("n"))


def totals(rows: DataFrame, frequency: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(frequency), F.lit(0)).alias("total_frequency"))


def most_frequent(rows: DataFrame, frequency: str, name: str, k: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(frequency), name).limit(k)


def dependencies(skills: DataFrame) -> DataFrame:
    """Edges (dependency, skill_name) of skills that compose others."""
    return skills.select(F.explode("composes_with").alias("dependency"), "skill_name")


def _badge(column: Column, table: dict[str, str], other: str) -> Column:
    return exprs.lookup(column, table, F.lit(other))


def parameter_table(parameters: Column) -> Column:
    row = lambda p: F.concat(
        F.lit("| `"), F.coalesce(p["name"], F.lit("")), F.lit("` | `"), F.coalesce(p["type"], F.lit("any")), F.lit("` | "), F.coalesce(p["default"], F.lit("required")),
        F.lit(" | "), F.coalesce(p["description"], F.lit("")), F.lit(" |"),
    )
    head = F.array(F.lit("| Parameter | Type | Default | Description |"), F.lit("|---|---|---|---|"))
    return F.when(F.size(parameters) > 0, F.array_join(F.concat(head, F.transform(parameters, row)), "\n"))


def _lines(*parts: Column | str) -> Column:
    """Parts joined by line ends; null parts are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _listed(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")


def skill_page(skill_dir: str = "") -> Column:
    """One skill as Markdown with frontmatter."""
    c = F.col
    ending = exprs.file_ending(c("language"))
    triggers = F.array_join(F.transform(F.concat(F.array(F.replace(c("skill_name"), F.lit("_"), F.lit(" "))), F.slice("tags", 1, 3)), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
    fence = F.concat(F.lit("```"), c("language"))
    return _lines(
        "---", F.concat(F.lit("name: "), exprs.kebab(c("skill_name"))),
        F.concat(F.lit("description: "), c("description"), F.lit(" Use for "), triggers, F.lit(". Seen "), c("frequency").cast("string"), F.lit(" times.")),
        "metadata:", F.concat(F.lit("  category: "), c("category")), F.concat(F.lit("  complexity: "), c("complexity")), F.concat(F.lit("  language: "), c("language")),
        F.concat(F.lit("  tags: ["), F.array_join("tags", ", "), F.lit("]")), F.concat(F.lit("  observed: "), c("frequency").cast("string")), "---", "",
        F.concat(F.lit("# "), exprs.title(c("skill_name"))), "", c("description"), "", "## Usage", "", fence, c("usage_example"), "```", "",
        "## Implementation", "", F.concat(F.lit("File: `scripts/"), c("skill_name"), F.lit("."), ending, F.lit("`")), "", fence, c("code"), "```",
        F.concat(F.lit("\n## Parameters\n\n"), parameter_table(c("parameters"))),
        F.when(F.size("composes_with") > 0, F.concat(F.lit("\n## Composes with\n\n"), _listed(c("composes_with")))),
    )


def code_file() -> Column:
    """A skill's code under a header."""
    c = F.col
    mark = F.when(c("language") == "python", "#").otherwise("//")
    head = lambda name, value: F.concat(mark, F.lit(f" {name}: "), value)
    return _lines(
        head("pattern", c("pattern_hash")), head("observed", c("frequency").cast("string")), head("category", c("category")), head("tags", F.array_join("tags", ", ")),
        head("usage", c("usage_example")), "", F.concat(c("code"), F.lit("\n")),
    )


def skill_files(skills: DataFrame) -> DataFrame:
    """(path, content) of all files of each skill: page, code, examples with five contexts, metadata."""
    folder = exprs.kebab(F.col("skill_name"))
    at = lambda *p: F.concat_ws("/", folder, *p)
    examples = _lines("# Examples", "", F.array_join(F.transform(F.slice("contexts", 1, 5), lambda x: F.concat(F.lit("- "), x)), "\n"))
    script = F.concat(F.col("skill_name"), F.lit("."), exprs.file_ending(F.col("language")))
    files = F.array(
        F.struct(at(F.lit("SKILL.md")).alias("path"), skill_page().alias("content")),
        F.struct(at(F.lit("scripts"), script).alias("path"), code_file().alias("content")),
        F.struct(at(F.lit("references"), F.lit("examples.md")).alias("path"), examples.alias("content")),
        F.struct(at(F.lit("meta.json")).alias("path"), F.to_json(F.struct(*[F.col(c) for c in skills.columns])).alias("content")),
    )
    return skills.select(F.explode(files).alias("f")).select("f.path", "f.content")


def index_sections(skills: DataFrame) -> DataFrame:
    """(category, position, text): the index page in order; a header for each category, then its skills by name."""
    c = F.col
    near = related(skills, "skill_name", "tags").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "related_name"))), lambda s: s["related_name"]).alias("near"))
    joined = skills.join(near.withColumnRenamed("name", "skill_name"), "skill_name", "left")
    entry = _lines(
        F.concat(F.lit("### `"), c("skill_name"), F.lit("` "), _badge(c("language"), LANGUAGE_BADGES, ""), F.lit(" "), exprs.maturity(c("frequency"))), c("description"),
        F.concat(F.lit("- Page: "), exprs.kebab(c("skill_name")), F.lit("/SKILL.md")), F.concat(F.lit("- Complexity: "), c("complexity")),
        F.concat(F.lit("- Observed: "), c("frequency").cast("string")), F.concat(F.lit("- Tags: "), _listed(c("tags"))),
        F.when(F.size("composes_with") > 0, F.concat(F.lit("- Composes with: "), _listed(c("composes_with")))), parameter_table(c("parameters")),
        F.concat(F.lit("```"), c("language"), F.lit("\n"), c("usage_example"), F.lit("\n```")), F.concat(F.lit("> Related: "), _listed(c("near"))),
    )
    entries = joined.select("category", c("skill_name").alias("position"), entry.alias("text"))
    by = skills.groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("language")).alias("languages"))
    badges = F.array_join(F.transform("languages", lambda x: _badge(x, LANGUAGE_BADGES, "")), " ")
    head = F.concat(F.lit("## "), _badge(c("category"), CATEGORY_BADGES, "🔧"), F.lit(" "), exprs.title(c("category")), F.lit(" ("), c("n").cast("string"), F.lit(") "), badges)
    edges = dependencies(skills).select(F.lit("~dependencies").alias("category"), F.concat_ws(" ", "dependency", "skill_name").alias("position"), F.concat_ws(" --> ", "dependency", "skill_name").alias("text"))
    return by.select("category", F.lit("").alias("position"), head.alias("text")).unionByName(entries).unionByName(edges).orderBy("category", "position")


def editor_rules(skills: DataFrame) -> DataFrame:
    """One line for each skill, by name."""
    c = F.col
    line = F.concat(F.lit("- `"), exprs.kebab(c("skill_name")), F.lit("` — "), c("description"), F.lit(" ["), c("category"), F.lit("] "), _badge(c("language"), LANGUAGE_BADGES, ""))
    return skills.select("skill_name", line.alias("line")).orderBy("skill_name")
