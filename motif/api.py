"""The library of skills as one object: what editors and assistants ask of it, answered with DataFrames."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motif.functions.parse import parse_files
from motif.operators import compositions, crystallize, patterns, registry
from motif.operators import search as searching
from motif.operators.index import SearchIndex
from motif.schema import SKILL, Settings
from motif.sources import files, sinks
from motif.storage import fresh_path

COLUMNS = (
    "skill_name category description tags code usage_example complexity composes_with parameters pattern_hash frequency contexts language node_type "
    "crystallized_at"
).split()


#: Skills written since an index was fitted, for each one it was fitted on, beyond which it is fitted again.
REFIT = 0.2


class Library:
    """Skills in a folder. Writes replace a skill's files; a read sees what is there."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), model: crystallize.Model = crystallize.offline):
        self.spark, self.path, self.settings, self.model = spark, path, settings, model

    def skills(self) -> DataFrame:
        return files.read_skills(self.spark, self.path)

    def search(self, query: str, k: int | None = None, mode: str = "auto") -> DataFrame:
        """Skills with score. Where embed() has made an index of two skills or more, TF-IDF scores are read from it."""
        k = k or self.settings.max_results
        kept = self.kept_index()
        if mode == "keyword" or not query.strip() or not kept.there() or len(kept.rows().take(2)) < 2:
            return searching.search(self.skills(), query, k, mode)
        hits = kept.search(self.spark.createDataFrame([(0, query)], "query int, text string"), k).select("skill_name", "score").collect()  # k rows
        scored = self.spark.createDataFrame(hits, "skill_name string, score double")
        return files.read_named(self.spark, self.path, [h["skill_name"] for h in hits]).join(F.broadcast(scored), "skill_name").orderBy(F.desc("score"), "skill_name")

    def kept_index(self) -> SearchIndex:
        return SearchIndex(self.spark, f"{self.path}/_index", "skill_name")

    def get(self, name: str) -> DataFrame:
        """The skill of that name with its page; no row if there is none. Opens that skill's file alone, if it is in its folder."""
        return files.read_named(self.spark, self.path, [name]).withColumn("page", registry.skill_page())

    def list(self, category: str | None = None) -> DataFrame:
        found = self.skills()
        return (found.where(F.col("category") == category) if category else found).orderBy("category", "skill_name")

    def index(self) -> DataFrame:
        return registry.index_sections(self.skills())

    def embed(self) -> str:
        """Writes the library's vectors beside its skills: TF-IDF weights of two skills or more, the hash vector of one.

        Of two skills or more it also fits the index that search() reads. register() keeps it up to date from then on.
        """
        skills = self.skills().withColumn("_text", searching.skill_text())
        path = f"{self.path}/_vectors"
        if len(skills.take(2)) > 1:
            vectors = searching.TfIdf(skills, "skill_name", "_text").weights
            self.kept_index().fit(skills, "_text")
        else:
            vectors = searching.hash_buckets(skills, "skill_name", "_text").select("skill_name", F.col("bucket").cast("string").alias("term"), "weight")
        sinks.write_vectors(vectors, path)
        return path

    def vectors(self) -> DataFrame:
        """(skill_name, term, weight) as embed() wrote them."""
        return files.read_vectors(self.spark, f"{self.path}/_vectors")

    def stats(self) -> dict[str, DataFrame]:
        found = self.skills()
        return {
            "totals": registry.totals(found, "frequency"),
            "categories": registry.count_by(found, "category").orderBy(F.desc("n"), "category"),
            "languages": registry.count_by(found, "language").orderBy("language"),
            "top": registry.most_frequent(found.select("skill_name", "frequency"), "frequency", "skill_name"),
        }

    def register(self, new: DataFrame) -> None:
        """Writes skills; of several with one name, the latest. Rules and vectors derive from the files when asked for.

        A kept index gets the new skills under its fit, and is fitted anew when a fifth as many have come as it was fitted on.
        """
        latest = registry.upsert(new.select(*COLUMNS), "skill_name", "crystallized_at", "pattern_hash")
        sinks.write_tree(registry.skill_files(latest), self.path)
        kept = self.kept_index()
        if kept.there():
            kept.upsert(latest.withColumn("_text", searching.skill_text()), "_text")
            if kept.grown() > REFIT:
                kept.fit(self.skills().withColumn("_text", searching.skill_text()), "_text")

    def learn(self, events: DataFrame) -> DataFrame:
        """Candidates of file events (event_seq, path, source) and, if wanted, compositions, crystallized and registered."""
        units = parse_files(events)
        shape = ["structural_hash", "source_code", "language", "frequency", "contexts", "node_type"]
        found = patterns.candidates(units, self.settings).select(*shape)
        if self.settings.detect_compositions:
            found = found.unionByName(crystallize.from_compositions(compositions.compositions(units, self.settings.min_co_occurrence)).select(*shape))
        return self.crystallized(found)

    def crystallized(self, found: DataFrame) -> DataFrame:
        """Skills made of candidates, registered. What fails beyond the model itself is tried three times.

        Answers are kept beside the skills, so no attempt, and no later run, asks the same model the same thing again.
        """
        return crystallize.attempted(lambda: self._crystallized(found))

    def _crystallized(self, found: DataFrame) -> DataFrame:
        made = crystallize.crystallize(found, self.model, time.time(), f"{self.path}/_answers", crystallize.active_model(self.settings))
        # One set of answers is registered and returned: a model may answer differently when asked again.
        path = fresh_path(self.spark, "skills")
        made.select(*COLUMNS).write.parquet(path)
        kept = self.spark.read.schema(SKILL).parquet(path)
        self.register(kept)
        return kept

    def submit(self, snippets: list[tuple[str, str, str]], seen: DataFrame | None = None) -> DataFrame:
        """Learns from snippets (code, language, context), after events seen before; compositions are not looked for."""
        first = 0 if seen is None else (seen.agg(F.max("event_seq")).first()[0] or 0) + 1
        new = files.submissions(self.spark, snippets, first)
        once = Library(self.spark, self.path, self._without_compositions(), self.model)
        return once.learn(new if seen is None else seen.select(*new.columns).unionByName(new))

    def _without_compositions(self) -> Settings:
        from dataclasses import replace

        return replace(self.settings, detect_compositions=False)
