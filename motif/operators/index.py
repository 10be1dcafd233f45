"""A kept search index: the TF-IDF weights of rows as a table of postings, which many searches read and few rows change.

Rows are put in blocks of similar rows: those with the same heaviest term, in a sixteenth of its weight, and a share of their
keys. A table of the greatest weight of each term in each block gives every block a bound for a query. The few blocks with the
greatest bounds are scored first; then only blocks whose bound reaches the k-th score found there are read. All of a row's
postings lie in one block, so a score is whole wherever it is computed, and the results are those of scoring all rows.

Below the index's path, all Parquet, each with a folder for a fit and a generation in it: `features` (term, idf), `postings`
(term, block, key, weight) and `bounds` (term, block, greatest), both by bucket of the term, so that a search lists only its
terms' folders; `rows` (key, digest), written last, so a generation counts when its rows are there. A fit makes generation 0;
an upsert adds a generation of the changed rows, weighed by the fit's idf, and readers take a key's latest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motif.operators.search import FEATURES, TfIdf, weigh
from motif.storage import fresh_path, table_if_there

#: Folders of terms, about so many rows in a block, and blocks of a query that are scored first.
BUCKETS, BLOCK, SEEDS = 64, 512, 4
#: About so many rows have their postings of a bucket in one task and file.
SHARE = 200_000
#: More bounds than this are compared by a join alone, without a filter that the reader of files can use.
LISTED = 2000


def bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


class SearchIndex:
    """The index at a path over rows with a key column. It is there after fit(); others may read it while it is changed."""

    def __init__(self, spark: SparkSession, path: str, key: str, features: int = FEATURES):
        self.spark, self.path, self.key, self.features = spark, path.rstrip("/"), key, features

    def _state(self) -> tuple[int, int] | None:
        """The latest fit and its latest generation."""
        rows = table_if_there(self.spark, f"{self.path}/rows")
        return None if rows is None else rows.agg(F.max(F.struct("fit", "gen"))).select("max(struct(fit, gen)).*").first()

    def there(self) -> bool:
        found = self._state()
        return found is not None and found[0] is not None

    def _read(self, name: str, fit: int) -> DataFrame | None:
        return table_if_there(self.spark, f"{self.path}/{name}/fit={fit}")

    def rows(self) -> DataFrame:
        """(key, digest, gen) of every key, of its latest generation."""
        fit, gen = self._state()
        rows = self._read("rows", fit).where(F.col("gen") <= gen)
        return rows.groupBy(self.key).agg(F.max(F.struct("gen", "digest")).alias("_r")).select(self.key, "_r.digest", "_r.gen")

    def _write(self, weights: DataFrame, rows: DataFrame, n: int, fit: int, gen: int) -> None:
        at = f"fit={fit}/gen={gen}"
        heaviest = F.max(F.struct("weight", "term")).over(Window.partitionBy(self.key))
        slices = max(1, n // (16 * BLOCK))
        block = F.xxhash64(F.lit(gen), F.col("_h.term"), F.floor(F.col("_h.weight") * 16), F.pmod(F.xxhash64(self.key), F.lit(slices)))
        placed = weights.withColumn("_h", heaviest).select(bucket().alias("bucket"), "term", block.alias("block"), self.key, "weight")
        # A bucket goes to tasks in shares of its blocks, as a term may be in very many rows. Ranges would weigh all rows once more for a sample.
        order = ["bucket", "term", "block"]
        shares = F.col("bucket"), F.pmod("block", F.lit(1 + n // SHARE))
        placed.repartition(*shares).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/{at}")
        written = table_if_there(self.spark, f"{self.path}/postings/{at}")
        if written is not None:
            bounds = written.groupBy(*order).agg(F.max("weight").alias("greatest"))
            bounds.repartition(*shares).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/bounds/{at}")
        rows.select(self.key, "digest").write.mode("overwrite").parquet(f"{self.path}/rows/{at}")

    def fit(self, rows: DataFrame, text: str) -> int:
        """A new fit over rows, which have each key once: features, idf and all postings. Until it is whole the last one serves.

        Returns how many rows there are.
        """
        state = self._state()
        fit = 0 if state is None or state[0] is None else state[0] + 1
        model = TfIdf(rows, self.key, text, self.features)
        model.idf.write.mode("overwrite").parquet(f"{self.path}/features/fit={fit}")
        self._write(model.weights, rows.withColumn("digest", digest(text)), model.n, fit, 0)
        return model.n

    def changed(self, rows: DataFrame, text: str) -> DataFrame:
        """rows with digest: those whose key is new or whose text is another."""
        old = self.rows().select(self.key, F.col("digest").alias("_old"))
        return rows.withColumn("digest", digest(text)).join(old, self.key, "left").where("_old is null or _old != digest").drop("_old")

    def upsert(self, rows: DataFrame, text: str) -> int:
        """Adds or replaces rows, which have each key once, under the features and idf of the last fit. Returns how many changed."""
        fit, gen = self._state()
        new = self.changed(rows, text)
        n = new.count()
        if n:
            self._write(weigh(new, self.key, text, self._read("features", fit)), new, n, fit, gen + 1)
        return n

    def grown(self) -> float:
        """Rows of later generations, for each row of the fit: how far idf may have moved."""
        fit, gen = self._state()
        first, later = self._read("rows", fit).where(F.col("gen") <= gen).agg(F.count_if(F.col("gen") == 0), F.count_if(F.col("gen") > 0)).first()
        return later / max(1, first)

    def _asked(self, queries: DataFrame, fit: int) -> DataFrame:
        return weigh(queries, "query", "text", self._read("features", fit)).withColumnRenamed("weight", "qw")

    def _of_terms(self, name: str, fit: int, gen: int, terms: list) -> DataFrame | None:
        found = self._read(name, fit)
        if found is None:
            return None
        return found.where(F.col("gen") <= gen).where(F.col("bucket").isin(sorted({t["bucket"] for t in terms}))).where(F.col("term").isin([t["term"] for t in terms]))

    def _bounds(self, asked: DataFrame, fit: int, gen: int, terms: list) -> DataFrame | None:
        """(query, block, bound): no row of the block scores more. Rows that were replaced since only raise it."""
        found = self._of_terms("bounds", fit, gen, terms)
        if found is None:
            return None
        return found.join(asked, "term").groupBy("query", "block").agg(F.sum(F.col("greatest") * F.col("qw")).alias("bound"))

    def _scores(self, pairs: DataFrame, asked: DataFrame, k: int, fit: int, gen: int, terms: list) -> DataFrame:
        """(query, key, score, rank): the k best of the rows in the pairs (query, block)."""
        postings = self._of_terms("postings", fit, gen, terms)
        few = pairs.select("block").distinct().limit(LISTED + 1).collect()
        if len(few) <= LISTED:
            postings = postings.where(F.col("block").isin([r["block"] for r in few]))
        hits = postings.join(asked, "term").join(pairs.select("query", "block"), ["query", "block"]).groupBy("query", self.key, "gen").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))
        if gen:
            newest = self._read("rows", fit).where(F.col("gen").between(1, gen)).groupBy(self.key).agg(F.max("gen").alias("_newest"))
            hits = hits.join(newest, self.key, "left").where("_newest is null or gen = _newest").drop("_newest")
        order = Window.partitionBy("query").orderBy(F.desc("score"), self.key)
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", self.key, "score", "rank")

    def _reached(self, bounds: DataFrame, asked: DataFrame, k: int, fit: int, gen: int, terms: list) -> DataFrame:
        """The pairs (query, block) whose bound reaches the k-th score of the blocks with the greatest bounds."""
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
        seeds = bounds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SEEDS)
        least = self._scores(seeds, asked, k, fit, gen, terms).where(F.col("rank") == k).select("query", F.col("score").alias("_least"))
        # Scores are rounded; a bound that rounds to less can't reach one. The slack covers sums in another order.
        pairs = bounds.join(least, "query", "left").where("_least is null or round(bound + 1e-9, 6) >= _least").drop("_least")
        path = fresh_path(self.spark, "reached")  # read twice: for the list of blocks, and with their postings
        pairs.write.parquet(path)
        return self.spark.read.schema(pairs.schema).parquet(path)

    def _prepared(self, queries: DataFrame):
        fit, gen = self._state()
        asked = self._asked(queries, fit)
        terms = asked.select("term", bucket().alias("bucket")).distinct().collect()  # features at most
        return fit, gen, asked, terms, self._bounds(asked, fit, gen, terms)

    def reach(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query, blocks, scored): how many blocks hold a term of the query, and how many of them a search reads."""
        fit, gen, asked, terms, bounds = self._prepared(queries)
        read = self._reached(bounds, asked, k, fit, gen, terms).groupBy("query").agg(F.count("*").alias("scored"))
        return bounds.groupBy("query").agg(F.count("*").alias("blocks")).join(read, "query")

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query, key, score, rank): for each of the queries (query, text) the k rows with the greatest cosine.

        As in TfIdf.search, ties go by key, and rows without a common term follow at zero while there are fewer than k. A
        blank query, or one without a feature, gets zeros only. An index of no rows gives none.
        """
        fit, gen, asked, terms, bounds = self._prepared(queries)
        live = self.rows()
        if bounds is None:
            hits = live.select(F.lit(None).alias("query"), self.key, F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
        else:
            hits = self._scores(self._reached(bounds, asked, k, fit, gen, terms), asked, k, fit, gen, terms)
        first = [r[self.key] for r in live.orderBy(self.key).limit(2 * k).collect()]
        if not first:
            return hits
        had = hits.groupBy("query").agg(F.count("*").alias("_had"), F.collect_list(self.key).alias("_keys"))  # k keys of a query at most
        short = queries.select("query").join(had, "query", "left").withColumn("_had", F.coalesce("_had", F.lit(0))).where(F.col("_had") < k)
        others = F.filter(F.array(*map(F.lit, first)), lambda x: ~F.array_contains(F.coalesce("_keys", F.array().cast(live.select(F.array(self.key)).dtypes[0][1])), x))
        zeros = short.select("query", "_had", F.posexplode(others).alias("_p", self.key)).withColumn("rank", F.col("_had").cast("int") + F.col("_p") + 1).where(F.col("rank") <= k)
        return hits.unionByName(zeros.select("query", self.key, F.lit(0.0).alias("score"), "rank"))
