"""Files as tables: source trees, snapshots and their changes, candidates and skills."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motif.functions import exprs
from motif.operators.registry import merge_layouts
from motif.schema import CANDIDATE, FILE_ENDINGS, SKILL, SNAPSHOT, Settings


def wanted(path: Column, settings: Settings = Settings()) -> Column:
    """Whether a path has a watched extension (in this case) and no ignored directory."""
    ending = reduce(lambda a, b: a | b, [F.endswith(path, F.lit(e)) for e in settings.extensions])
    return ending & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, settings.ignored_dirs)))


def not_ignored(path: Column, settings: Settings = Settings()) -> Column:
    """Whether no ignored glob matches the path."""
    return ~reduce(lambda a, b: a | b, [exprs.glob_match(path, g) for g in settings.ignored_globs])


def scan(spark: SparkSession, dirs: list[str], settings: Settings = Settings()) -> DataFrame:
    """(path, mtime, content) of all wanted files below the directories; each directory counts once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load([*dict.fromkeys(d.rstrip("/") for d in dirs)])
    files = files.where(wanted(F.col("path"), settings))
    return files.select("path", F.unix_micros("modificationTime").cast("double").alias("micros"), "content").select("path", (F.col("micros") / 1e6).alias("mtime"), "content")


def snapshot(files: DataFrame) -> DataFrame:
    return files.select("path", "mtime")


def changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, mtime) that are new or have another time; what went is not told."""
    before = previous.select("path", F.col("mtime").alias("before"))
    return current.join(before, "path", "left").where("before is null or mtime != before").drop("before")


def first_snapshot(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SNAPSHOT)


def decoded(files: DataFrame) -> DataFrame:
    """files with source: UTF-8, invalid bytes left out."""
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.withColumn("source", text).drop("content")


def as_events(files: DataFrame) -> DataFrame:
    """files (path, mtime, source) as save events in order of time, then path."""
    return files.select(F.unix_micros(F.timestamp_seconds("mtime")).alias("event_seq"), "path", exprs.language_of(F.col("path")).alias("language"), "source", F.timestamp_seconds("mtime").alias("event_ts"))


def submissions(spark: SparkSession, snippets: list[tuple[str, str, str]], first_seq: int = 0) -> DataFrame:
    """Snippets (code, language, context) as events; unknown languages count as Python, a blank context as manual_submission."""
    rows = [(first_seq + i, f"{context or 'manual_submission'}.{FILE_ENDINGS.get(language, 'py')}", code) for i, (code, language, context) in enumerate(snippets)]
    return spark.createDataFrame(rows, "event_seq long, path string, source string")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate files, one JSON object each; files that can't be read so are left out, missing lists are empty."""
    raw = spark.read.schema(f"{CANDIDATE}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(f"{path}/*.json")
    empty = F.array().cast("array<string>")
    good = raw.where("_bad is null and structural_hash is not null").drop("_bad")
    return good.withColumns({"node_type": F.coalesce("node_type", F.lit("function")), "decorators": F.coalesce("decorators", empty), "calls": F.coalesce("calls", empty)})


def occurrences(candidates: DataFrame) -> DataFrame:
    """One event for each context of restored candidates."""
    return candidates.select("structural_hash", "language", F.posexplode("contexts").alias("pos", "context"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("skill_name string, term string, weight double").parquet(path)


def _skill_rows(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of metadata files; files that can't be read so, or have no name, are left out."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema(f"{SKILL}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(glob)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SKILL)
    return found.where("_bad is null and skill_name is not null").drop("_bad")


def _filled(skills: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, empty) for c in ("tags", "composes_with", "contexts")}
    return skills.withColumns({"language": F.coalesce("language", F.lit("python")), "frequency": F.coalesce("frequency", F.lit(0).cast("long")), **lists})


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """Skill metadata of both layouts; a folder's meta.json wins over a legacy file of the same name. Stored times stay."""
    return _filled(merge_layouts(_skill_rows(spark, f"{path}/*/meta.json"), _skill_rows(spark, f"{path}/*.meta.json"), "skill_name"))


def read_named(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The skills of a few names, as read_skills gives them.

    The writer's folder follows from a name, so only those folders' files are opened. If a name isn't found there, it may be
    in a file of the legacy layout, whose names don't tell, and the whole library is read.
    """
    names = sorted(set(names))
    if names and all(re.fullmatch(r"[\w.-]+", n) for n in names):
        folders = ",".join(sorted({n.replace("_", "-") for n in names}))
        found = _skill_rows(spark, f"{path}/{{{folders}}}/meta.json").where(F.col("skill_name").isin(names))
        if found.select("skill_name").distinct().count() == len(names):
            return _filled(found)
    return read_skills(spark, path).where(F.col("skill_name").isin(names))
