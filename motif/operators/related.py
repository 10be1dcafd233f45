"""Top-k overlap join: for each row the k others that share most distinct tags, exact whatever the tags' frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motif.storage import kept

RARE = 1000  # classes that a tag may have and still be joined class by class
WIDTH = 8  # frequent tags of a class whose subsets are all keys: 255 at most
SALTS = 16

ITEM = ["class", "other", "related_name", "overlap"]


def _firsts(rows: DataFrame, by: str, order: list[Column | str], n: int) -> DataFrame:
    """The n first rows of each key: a task sends n of a key at most, so a hot key brings few."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def _best(items: DataFrame, k: int) -> DataFrame:
    return _firsts(items, "class", [F.desc("overlap"), "related_name"], k + 1)


def classes(rows: DataFrame, k: int, rare: int = RARE) -> DataFrame:
    """(class, firsts, tags, cold) of rows (name, tags): the distinct tag sets, with their k+1 first names.

    tags are ordered alike in all classes: those of at most `rare` classes first (cold of them), then the frequent ones,
    the rarest first.
    """
    few = _firsts(rows, "tags", ["name"], k + 1).groupBy("tags").agg(F.sort_array(F.collect_list("name")).alias("firsts"))
    each = few.select(F.xxhash64("tags").alias("class"), "firsts", F.explode("tags").alias("tag"))
    hot = each.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") > rare)
    ordered = each.join(hot, "tag", "left").groupBy("class").agg(
        F.any_value("firsts").alias("firsts"), F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tag"))).alias("t")
    )
    return ordered.select("class", "firsts", F.col("t.tag").alias("tags"), F.size(F.filter("t", lambda t: t["n"] == 0)).alias("cold"))


def _meet(asking: DataFrame, having: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
    """Items of classes that meet on a tag; a pair counts at its rarest common tag alone, so it comes once.

    Of the others the k+1 best by overlap and first name are enough: each has a name that is better than any of the rest.
    """
    pairs = asking.join(having, "tag")
    if condition is not None:
        pairs = pairs.where(condition)
    pairs = pairs.withColumn("_both", F.array_intersect("tags", "otags")).where(F.get("_both", F.lit(0)) == F.col("tag"))
    pairs = pairs.select("class", "other", "firsts", F.size("_both").cast("long").alias("overlap"), F.get("firsts", F.lit(0)).alias("_f"))
    kept = _firsts(pairs, "class", [F.desc("overlap"), "_f"], k + 1)
    return kept.select("class", "other", F.explode("firsts").alias("related_name"), "overlap")


def _by_rare(sets: DataFrame, k: int) -> DataFrame:
    """Items of classes with a rare tag in common: a tag brings `rare` others at most."""
    tag = F.explode(F.slice("tags", F.lit(1), F.col("cold"))).alias("tag")
    asking = sets.select("class", "tags", tag)
    having = sets.select(F.col("class").alias("other"), F.col("tags").alias("otags"), "firsts", tag)
    return _meet(asking, having, k)


def _subsets(tags: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.pow(F.lit(2), F.size(tags)).cast("int") - 1), lambda m: F.filter(tags, lambda t, i: F.getbit(m, i) == 1))


def _by_frequent(sets: DataFrame, k: int, width: int) -> DataFrame:
    """Items of classes with frequent tags in common, from the first k+1 names of every subset of these.

    Who has o tags in common with a class shares a subset of o tags with it; if k+1 names come before under that subset, they
    are k+1 better answers. So no list of a frequent tag is read beyond k+1 names. Of more than `width` frequent tags
    the rarest count, which understates the overlap.
    """
    hot = sets.select("class", "firsts", F.slice("tags", F.col("cold") + 1, F.lit(width)).alias("hot")).where(F.size("hot") > 0)
    names = _firsts(hot.select("hot", F.col("class").alias("other"), F.explode("firsts").alias("related_name")), "hot", ["related_name"], k + 1)
    listed = _firsts(names.select("other", "related_name", F.explode(_subsets(F.col("hot"))).alias("key")), "key", ["related_name"], k + 1)
    asked = hot.select("hot").distinct().select("hot", F.explode(_subsets(F.col("hot"))).alias("key"))
    found = asked.join(listed, "key").groupBy("hot", "other", "related_name").agg(F.max(F.size("key")).cast("long").alias("overlap"))
    found = _firsts(found, "hot", [F.desc("overlap"), "related_name"], k + 1)
    # A set of frequent tags may stand in a third of all classes: its answers are copied, its classes spread.
    copies = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = hot.select("class", "hot", F.pmod("class", F.lit(SALTS)).cast("int").alias("salt"))
    return spread.join(copies, ["hot", "salt"]).select(*ITEM)


def _by_bound(sets: DataFrame, found: DataFrame, k: int, width: int) -> DataFrame:
    """Items of pairs of which one class has more than `width` frequent tags, where they can still be among the k+1 best.

    found gives each class a bound b: k+1 others have b common tags or more. A pair of b common tags shares one of all but
    the b-1 most frequent tags on either side, so only these are joined, and the bound rises with what was found.
    """
    bound = found.groupBy("class").agg(F.when(F.count("*") > k, F.min("overlap")).otherwise(1).alias("bound"))
    size, place = F.size("tags"), F.col("cold") + F.col("p") + 1
    each = sets.join(bound, "class", "left").withColumn("bound", F.coalesce("bound", F.lit(1)))
    each = each.select("*", (F.size("tags") - F.col("cold") > width).alias("wide"), F.posexplode(F.slice("tags", F.col("cold") + 1, F.size("tags"))).alias("p", "tag"))
    each = each.select("class", "firsts", "tags", "bound", "wide", "tag", (size - place + 1).alias("rest"))
    asking = each.where("rest >= bound").select("class", "tags", "bound", "wide", "tag")
    having = each.select(F.col("class").alias("other"), F.col("tags").alias("otags"), "firsts", "rest", F.col("wide").alias("owide"), "tag")
    can = F.col("rest") >= F.col("bound")
    return _meet(asking.where("wide"), having, k, can).union(_meet(asking.where("not wide"), having.where("owide"), k, can))


def related(rows: DataFrame, name: str, tags: str, k: int = 3, rare: int = RARE, width: int = WIDTH) -> DataFrame:
    """(name, related_name, overlap, rank): for each row the k others that share most distinct tags, ties in order of name.

    Rows with equal tag sets form one class. Classes meet on their rare tags one by one, on their frequent tags by the first
    names of each subset of these; only classes of more than `width` frequent tags are joined on such tags, below a bound.
    The classes are written to the shared folder once, and what was found before a bound is taken from it.
    Rows without tags, null tags and repeated rows have no part; a row whose tags nobody shares has no answer.
    """
    each = rows.select(F.col(name).alias("name"), F.array_sort(F.array_distinct(F.array_compact(tags))).alias("tags")).where(F.size("tags") > 0).distinct()
    sets = kept(classes(each, k, rare), "tag-sets")
    most = sets.agg(F.max(F.size("tags") - F.col("cold"))).first()[0] or 0  # frequent tags of one class
    best = _by_rare(sets, k)
    if most > 0:
        best = best.union(_by_frequent(sets, k, width))
    if most > width:
        best = kept(_best(_once(best), k), "related")
        best = best.union(_by_bound(sets, best, k, width))
    best = _best(_once(best), k)
    # Copies of one set may be a third of all rows; one of the k+1 answers may be the row itself.
    copies = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = each.select("name", F.xxhash64("tags").alias("class"), F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int").alias("salt"))
    answers = spread.join(copies, ["class", "salt"]).where("name != related_name")
    order = Window.partitionBy("name").orderBy(F.desc("overlap"), "related_name")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("name", "related_name", "overlap", "rank")


def _once(items: DataFrame) -> DataFrame:
    return items.groupBy("class", "other", "related_name").agg(F.max("overlap").alias("overlap"))
