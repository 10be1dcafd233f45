"""The registered queries of the engine's own operators.

The test tables hold prose and orders, not code, so operators run on columns that stand in for theirs; those that need
code or answers of models run on the fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motif.functions import exprs, llmjson, parse, pyast, tokens
from motif.operators import compositions, crystallize, fuzzy, patterns, registry, search
from motif.operators.index import SearchIndex
from motif.plans import fixtures
from motif.plans.oracles import ASKED, K, SEARCHED
from motif.plans.oracles import ORACLES as ORACLES
from motif.schema import Settings
from motif.sources import files as sources
from motif.sources import sinks
from motif.storage import fresh_path, settings, table
from motif.streaming import changes, mining
from motif.streaming.promote import debounce, promote_stream

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _joined(c: str):
    return F.array_join(c, ",")


@query
def token_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tokens.token_hashes("text").alias("token_hash"))


@query
def promote_kth(spark: SparkSession, d: str) -> DataFrame:
    """Documents as events: the second occurrence of a token structure promotes it."""
    docs = table(spark, d, "documents").withColumn("key", tokens.token_hashes("text"))
    found = patterns.promote(docs, "key", ["doc_id"], 2, {"first_doc": F.col("doc_id"), "first_source": F.col("source")}, {"kth_doc": F.col("doc_id"), "lang": F.col("lang")}, {"contexts": F.col("source")})
    return found.select("key", "frequency", "first_doc", "first_source", "kth_doc", "lang", _joined("contexts").alias("contexts"))


@query
def promote_events(spark: SparkSession, d: str) -> DataFrame:
    """Each user's third event."""
    found = patterns.promote(table(spark, d, "events"), "user_id", ["event_id"], 3, {"first_event": F.col("event_id")}, {"kth_event": F.col("event_id")}, {"types": F.col("event_type")})
    return found.select("user_id", "frequency", "first_event", "kth_event", _joined("types").alias("types"))


@query
def ext_language(spark: SparkSession, d: str) -> DataFrame:
    """Languages of paths that end in part types, and of page addresses."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"))
    ends = F.array(*map(F.lit, ("a.py", "b.JS", "c/d.tsx", "e.ts", "f.jsx", "g.txt", ".py", "x.py/y")))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), F.get(ends, F.pmod("p_size", F.lit(8)))).alias("path"))
    return pages.unionByName(parts).select("id", "path", exprs.language_of(F.col("path")).alias("language"))


@query
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files: finished ones were there before, and urgent ones were touched since."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("mtime"), "o_orderstatus", "o_orderpriority")
    before = orders.where("o_orderstatus = 'F'").select("path", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    return sources.changed(orders.select("path", "mtime"), before)


@query
def snapshot_stream(spark: SparkSession, d: str) -> DataFrame:
    """snapshot_diff as a stream: two looks at orders as files, a run for each, the first one as state of the second."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("mtime"), "o_orderstatus", "o_orderpriority")
    before = orders.where("o_orderstatus = 'F'").withColumn("mtime", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("mtime") - 1).otherwise(F.col("mtime")))
    source, out = fresh_path(spark, "looks"), fresh_path(spark, "saves")
    for look, there in ((1, before), (2, orders)):
        parts = spark.range(64).select(F.col("id").cast("int").alias("part"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("double").alias("mtime"))
        rows = there.select(F.pmod(F.crc32("path"), F.lit(64)).cast("int").alias("part"), "path", "mtime").unionByName(parts)
        rows.withColumns({"look": F.lit(look).cast("long"), "first": F.lit(look == 1)}).write.mode("append").parquet(source)
        with settings(spark, mining.STORE):
            found = changes.changed(spark.readStream.schema(changes.LISTED).parquet(source))
            sink = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        sink.awaitTermination()
    return spark.read.schema(changes.SAVED).parquet(out).select("path", "mtime")


@query
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose address no glob matches."""
    settings = Settings(ignored_globs=("*/en/*", "*example.net*", "http://m.?????.*"))
    return table(spark, d, "pages").where(sources.not_ignored(F.col("url"), settings)).select("page_id", "url")


@query
def debounce_session(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user's runs without a pause of six hours."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return debounce(events, "user_id", "ts", "6 hours").select("user_id", "event_id", "event_type", F.col("n").cast("long").alias("n"))


@query
def regex_complexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", exprs.branch_complexity(F.coalesce("html", F.lit(""))).alias("complexity"))


@query
def bracket_balance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", exprs.brackets_balanced(F.coalesce("html", F.lit(""))).alias("balanced"))


@query
def abstract_signature(spark: SparkSession, d: str) -> DataFrame:
    """Roles of a conversation's turns as calls."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(roles.alias("calls")).select("conv_id", exprs.signature(F.lit("conversation"), F.col("conv_id").cast("string"), F.col("calls")).alias("signature"))


@query
def unit_classify(spark: SparkSession, d: str) -> DataFrame:
    """Parts as script units: names and texts of several kinds by size and type."""
    part = table(spark, d, "part")
    name = F.concat(F.when(F.col("p_size") < 15, "use").when(F.col("p_size") < 30, "").otherwise("get"), F.initcap(F.col("p_type")))
    text = F.concat(F.col("p_name"), F.when(F.col("p_retailprice") < 950, "</a>").when(F.col("p_retailprice") < 1000, " => 1").otherwise(""))
    kind = F.when(F.col("p_brand") == "Brand#1", "function_declaration").otherwise("arrow_function")
    return part.select("p_partkey", exprs.classify(name, text, kind).alias("node_type"))


@query
def fuzzy_tokens(spark: SparkSession, d: str) -> DataFrame:
    toks = table(spark, d, "documents").select("doc_id", exprs.fuzzy_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return toks.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


def _edited(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items, and each once more without its last fifth."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    return items.unionByName(items.select((F.col("item_id") + 1_000_000).alias("item_id"), F.expr("substring(text, 1, length(text) * 4 div 5)").alias("text")))


@query
def fuzzy_bound(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items whose token overlap allows the similarity."""
    found = fuzzy.overlap_bounds(_edited(spark, d), "item_id", "text", 0.85)
    return found.select("new_id", "old_id", F.col("n_new").cast("long").alias("n_new"), F.col("n_old").cast("long").alias("n_old"), F.col("overlap").cast("long").alias("overlap"))


@query
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    found = fuzzy.similar_pairs(_edited(spark, d), "item_id", "text", 0.85)
    return found.select("new_id", "old_id", F.round("ratio", 6).alias("ratio"))


@query
def fuzzy_rekey(spark: SparkSession, d: str) -> DataFrame:
    keyed = _edited(spark, d).select(exprs.token_hash(F.col("text")).alias("structural_hash"), F.col("item_id").alias("seq"), F.col("text").alias("source_code"))
    return fuzzy.rekey(keyed, 0.85).select("seq", "structural_hash", "new_hash")


@query
def fuzzy_rekey_order(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items and shortened ones in order of arrival; each shortened one comes twice more at the end."""
    items = _edited(spark, d)
    again = items.where("item_id >= 1000000").select((F.col("item_id") + 1_000_000).alias("item_id"), "text")
    arrived = items.unionByName(again).unionByName(again.withColumn("item_id", F.col("item_id") + 1_000_000))
    keyed = arrived.select(exprs.token_hash(F.col("text")).alias("structural_hash"), F.col("item_id").alias("seq"), F.col("text").alias("source_code"))
    return fuzzy.rekey_in_order(keyed, 0.85).select("seq", "structural_hash", "new_hash")


@query
def fuzzy_ratio_fixture(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of token sequences, which are not symmetric; empty ones have none."""
    pairs = spark.createDataFrame(fixtures.RATIOS, "id long, a string, b string")
    cut = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    return pairs.select("id", F.round(fuzzy.ratio(F.struct(cut("a").alias("a"), cut("b").alias("b"))), 6).alias("ratio"))


@query
def fuzzy_rekey_fixture(spark: SparkSession, d: str) -> DataFrame:
    """The second source joins the first one's hash, the third is too different, the fourth repeats the second's hash."""
    keyed = spark.createDataFrame(fixtures.REKEYED, "structural_hash string, seq long, source_code string")
    return fuzzy.rekey(keyed, 0.85).select("seq", "structural_hash", "new_hash")


@query
def candidate_files(spark: SparkSession, d: str) -> DataFrame:
    """The files that candidates are written to, with the fields a reader needs."""
    found = patterns.candidates(parse.parse_files(fixtures.files(spark, fixtures.PYTHON_FILES)))
    made = sinks.candidate_files(found)
    read = lambda name: F.get_json_object("content", f"$.{name}")
    return made.select(F.endswith("path", F.lit(".json")).alias("named"), read("language").alias("language"), read("frequency").cast("long").alias("frequency"), read("contexts").alias("contexts"))


@query
def skill_pages(spark: SparkSession, d: str) -> DataFrame:
    """First and last lines of the pages of skills."""
    page = F.split(registry.skill_page(), "\n")
    return fixtures.skills(spark).select("skill_name", F.get(page, F.lit(1)).alias("named"), F.get(page, F.lit(2)).alias("described"), F.element_at(page, -1).alias("last"))


@query
def decorators_and_sources(spark: SparkSession, d: str) -> DataFrame:
    """Decorators of units of both languages."""
    found = parse.parse_files(fixtures.files(spark, fixtures.DECORATED_FILES))
    return found.select("path", "name", _joined("decorators").alias("decorators"))


@query
def composition_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Compositions in the form of candidates, with the sources of their parts."""
    found = crystallize.from_compositions(compositions.compositions(parse.parse_files(fixtures.files(spark, fixtures.PIPELINE_FILES)), 2))
    return found.select("abstract_signature", "complexity_score", "node_type", F.regexp_count("source_code", F.lit("def ")).cast("long").alias("parts"), "first_seen_file")


@query
def skill_search_auto(spark: SparkSession, d: str) -> DataFrame:
    """With two skills or more the automatic mode ranks by TF-IDF: the skill with the word comes first."""
    return search.search(fixtures.skills(spark), "page", 1).select("skill_name")


def _user_days(spark: SparkSession, d: str) -> DataFrame:
    """Events as units of a file for each user and day: one unit for each event type, which calls the next."""
    events = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    firsts = events.groupBy("user_id", "day", "event_type").agg(F.min("event_id").alias("at"))
    w = Window.partitionBy("user_id", "day")
    ordered = w.orderBy("at")
    return firsts.select(
        F.min("at").over(w).alias("event_seq"), F.concat_ws("/", "user_id", F.col("day").cast("string")).alias("path"), (F.row_number().over(ordered) - 1).alias("unit_pos"), F.col("event_type").alias("name"),
        F.lit("python").alias("language"), F.col("event_type").alias("source_code"), F.lit("function").alias("node_type"),
        F.when(F.lead("event_type").over(ordered).isNotNull(), F.array(F.concat(F.lit("self."), F.lead("event_type").over(ordered)))).otherwise(F.array().cast("array<string>")).alias("calls"),
    )


@query
def cooccur_sets(spark: SparkSession, d: str) -> DataFrame:
    """How often each set of event types makes up a user's day, and its first five days.

    A handful of sets hold all days: they are counted by partial sums, and ranked under a limit that each task applies first.
    """
    sets = compositions.name_sets(_user_days(spark, d))
    ranked = sets.withColumn("r", F.row_number().over(Window.partitionBy("names").orderBy("event_seq"))).where(F.col("r") <= 5)
    first = ranked.groupBy("names").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda s: s["path"]).alias("contexts"))
    counted = sets.groupBy("names").agg(F.count("*").alias("n"))
    return counted.join(first, "names").select(_joined("names").alias("names"), "n", _joined("contexts").alias("contexts"))


@query
def call_chain(spark: SparkSession, d: str) -> DataFrame:
    return compositions.call_chains(_user_days(spark, d)).select("path", "unit_pos", _joined("chain").alias("chain"))


@query
def call_chain_joined(spark: SparkSession, d: str) -> DataFrame:
    """Orders as units of one large file for each priority, named by customer: some calls are local, and names repeat."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    called = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    calls = F.array(called("m.", c * 7 % 1000 + 1), called("self.", c + 1), called("x.y.", o % 50))
    units = table(spark, d, "orders").select(F.lit(0).alias("event_seq"), F.col("o_orderpriority").alias("path"), o.alias("unit_pos"), c.cast("string").alias("name"), calls.alias("calls"))
    return compositions.joined_chains(units).select("path", "unit_pos", _joined("chain").alias("chain"))


@query
def composition_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = compositions.compositions(_user_days(spark, d), 2)
    return found.select("name", _joined("component_names").alias("components"), "pattern_type", "frequency", _joined("contexts").alias("contexts"))


@query
def compositions_fixture(spark: SparkSession, d: str) -> DataFrame:
    found = compositions.compositions(parse.parse_files(fixtures.files(spark, fixtures.PIPELINE_FILES)), 2)
    return found.select("name", _joined("component_names").alias("components"), "pattern_type", "frequency", _joined("contexts").alias("contexts"), _joined("call_chain").alias("call_chain"))


@query
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("tags", F.split("p_name", " "))
    named = rows.withColumn("label", F.concat_ws(" ", "p_name", F.lpad(F.col("p_partkey").cast("string"), 9, "0")))
    return search.keyword_search(named, "Ring", "label", "p_type", "tags", "p_brand", 50).select("p_partkey", "label", "score")


@query
def tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns for two words that occur in them; words and pairs, 512 features."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return search.TfIdf(turns, "id", "text").search(SEARCHED, K)


@query
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns by a kept index: fitted on the users' turns, the others are put in afterwards; several searches at once."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    kept = SearchIndex(spark, fresh_path(spark, "index"), "id")
    kept.fit(turns.where("role = 'user'"), "text")
    kept.upsert(turns, "text")
    return kept.search(spark.createDataFrame(list(enumerate(ASKED)), "query int, text string"), K)


@query
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return search.hash_buckets(table(spark, d, "documents"), "doc_id", "text")


@query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Of every vector whose id is divisible by 100 the five nearest ones of all."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return search.nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)


@query
def related_tags(spark: SparkSession, d: str) -> DataFrame:
    """Parts that share most words of name and type."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("tags"))
    return registry.related(rows, "name", "tags").select("name", "related_name", "overlap", "rank")


@query
def category_stats(spark: SparkSession, d: str) -> DataFrame:
    return registry.count_by(table(spark, d, "documents"), "source")


@query
def language_stats(spark: SparkSession, d: str) -> DataFrame:
    return registry.count_by(table(spark, d, "documents"), "lang")


@query
def category_languages(spark: SparkSession, d: str) -> DataFrame:
    return registry.languages_by_category(table(spark, d, "documents"), "source", "lang")


@query
def library_totals(spark: SparkSession, d: str) -> DataFrame:
    return registry.totals(table(spark, d, "part"), "p_size")


@query
def top_frequency(spark: SparkSession, d: str) -> DataFrame:
    return registry.most_frequent(table(spark, d, "supplier"), "s_acctbal", "s_name").select("s_name", "s_acctbal")


@query
def sorted_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_name", exprs.shorten(F.col("s_name"), 12).alias("short")).orderBy("s_name")


@query
def category_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_type = 'ECONOMY'").select("p_partkey", "p_name")


@query
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_name = 'Supplier#000000003'").select("s_suppkey", "s_name", "s_nationkey")


@query
def maturity(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counted.select("o_custkey", "n", exprs.maturity(F.col("n")).alias("maturity"))


@query
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return registry.upsert(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query
def legacy_merge(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by nation over customers by nation: a nation without a supplier keeps its customer."""
    new = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min("s_name").alias("name"))
    old = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min("c_name").alias("name"))
    return registry.merge_layouts(new, old, "nation")


@query
def dependency_edges(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_name").alias("skill_name"), F.split("p_name", " ").alias("composes_with")).distinct()
    return registry.dependencies(parts)


@query
def unescape_code(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    code = F.when(F.contains(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\\n\\t\\\"x\\'")))
    return table(spark, d, "documents").select("doc_id", F.sha2(exprs.unescape_code(code), 256).alias("code_sha256"))


@query
def kebab_name(spark: SparkSession, d: str) -> DataFrame:
    snake = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    return table(spark, d, "part").select("p_partkey", exprs.kebab(snake).alias("kebab"), exprs.title(snake).alias("title"), exprs.file_ending(F.when(F.col("p_size") < 20, "tsx").otherwise("none")).alias("ending"))


@query
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null and source is not null and lang is not null")
    made = exprs.prompt(F.lit("function"), F.lit("python"), F.col("n_chars"), F.array("source", "lang", F.lit("x"), F.lit("y")), F.col("text"))
    return docs.select("doc_id", F.sha2(made, 256).alias("prompt_sha256"))


@query
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """A field of event properties after a trailing comma was put in and taken out."""
    broken = F.regexp_replace("props", r"\}$", " , }")
    return table(spark, d, "events").select("event_id", F.get_json_object(llmjson.without_trailing_commas(broken), "$.k").cast("long").alias("k"))


@query
def unwrap_response(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.when(F.col("value") < 10, F.concat(F.lit('{"skill": {"name": "'), "event_type", F.lit('"}}'))).when(F.col("value") < 20, F.concat(F.lit('{"skill_name": "'), "event_type", F.lit('"}'))).otherwise("{}")
    return table(spark, d, "events").select("event_id", llmjson.unwrapped_field(wrapped, "skill_name").alias("skill_name"))


@query
def category_normalise(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ("io", "Data Transform", "http", "error-handling", "database", "nonsense", "api_client/rest", "auth", "UI", "string_utils_x")))
    return table(spark, d, "part").select("p_partkey", exprs.normal_category(F.get(words, F.pmod("p_partkey", F.lit(10)).cast("int"))).alias("category"))


@query
def composite_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", exprs.composite_hash(F.split("p_name", " ")).alias("key"))


@query
def py_units(spark: SparkSession, d: str) -> DataFrame:
    found = parse.parse_files(fixtures.files(spark, fixtures.PYTHON_FILES))
    return found.select("path", "unit_pos", "name", "node_type", _joined("calls").alias("calls"), "line_start", "n_lines")


@query
def js_units(spark: SparkSession, d: str) -> DataFrame:
    found = parse.parse_files(fixtures.files(spark, fixtures.SCRIPT_FILES))
    return found.select("path", "unit_pos", "name", "node_type", "exports", _joined("calls").alias("calls"), "line_start", "n_lines")


@query
def py_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The two loaders are one pattern; nothing else is long and complex enough."""
    found = patterns.candidates(parse.parse_files(fixtures.files(spark, fixtures.PYTHON_FILES)))
    return found.select("first_seen_file", "frequency", "complexity_score", "abstract_signature", _joined("contexts").alias("contexts"))


@query
def py_complexity(spark: SparkSession, d: str) -> DataFrame:
    facts = fixtures.snippets(spark).select("id", pyast.python_facts("code").alias("f"))
    return facts.select("id", F.col("f.complexity").alias("complexity"), F.col("f.valid").alias("valid"))


@query
def py_hash_classes(spark: SparkSession, d: str) -> DataFrame:
    """The first snippet of the same structure; snippets that can't be parsed have none."""
    keyed = fixtures.snippets(spark).select("id", pyast.python_facts("code")["hash"].alias("key")).where("key != ''")
    return keyed.select("id", F.min("id").over(Window.partitionBy("key")).alias("first_id"))


@query
def submit_code(spark: SparkSession, d: str) -> DataFrame:
    """Two submitted snippets of the same structure make a candidate."""
    events = sources.submissions(spark, [(fixtures.LOADER, "python", ""), (fixtures.TWIN, "python", "editor"), ("let a = 1;", "typescript", "")])
    found = patterns.candidates(parse.parse_files(events))
    return found.select("first_seen_file", "frequency", _joined("contexts").alias("contexts"))


@query
def editor_rules(spark: SparkSession, d: str) -> DataFrame:
    return registry.editor_rules(fixtures.skills(spark))


@query
def skill_search(spark: SparkSession, d: str) -> DataFrame:
    """Fixture skills by keyword: name .8, description .5, each tag .3, code .2."""
    return search.search(fixtures.skills(spark), "JSON", 5, "keyword").select("skill_name", "score")


@query
def skill_tree(spark: SparkSession, d: str) -> DataFrame:
    """The files that a skill is written to."""
    return registry.skill_files(fixtures.skills(spark)).select("path")


@query
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    return llmjson.parse_answers(fixtures.answers(spark)).select("id", "skill_name", "category", "code", _joined("tags").alias("tags"))


@query
def stream_promote(spark: SparkSession, d: str) -> DataFrame:
    """promote_events as a stream over the files of events, written to the shared folder and read back."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    keyed = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("source"), F.col("event_type").alias("context"))
    out = fresh_path(spark, "stream")
    sink = promote_stream(keyed, 3).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    sink.awaitTermination()
    found = spark.read.schema("key string, frequency long, source string, first_context string, contexts array<string>, seq long").parquet(out)
    return found.select(F.col("key").cast("long").alias("user_id"), "frequency", F.col("seq").alias("kth_event"), _joined("contexts").alias("types"))


@query
def stream_compositions(spark: SparkSession, d: str) -> DataFrame:
    """composition_dedup as a stream over user days as files: two stateful operators, one after the other."""
    units = _user_days(spark, d)
    unit = F.struct("unit_pos", "name", "language", "source_code", "node_type", F.array().cast("array<string>").alias("decorators"), "calls", F.lit(False).alias("exports"), *[F.lit(1).alias(n) for n in ("line_start", "line_end", "n_lines")])
    files = units.groupBy("event_seq", "path").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    source, out = fresh_path(spark, "files"), fresh_path(spark, "compositions")
    files.write.parquet(source)
    saved = spark.readStream.schema(files.schema).parquet(source)
    with settings(spark, mining.STORE):
        found = mining.promoted(saved, Settings())
        sink = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    sink.awaitTermination()
    chain, names = F.col("kind") == mining.CHAIN, F.col("calls")
    found = spark.read.schema(found.schema).parquet(out).where(F.col("kind") != mining.UNIT)
    return found.select(
        compositions.name_of(chain, names).alias("name"), _joined("calls").alias("components"), F.when(chain, "pipeline").otherwise("co_occurrence").alias("pattern_type"), "frequency", _joined("contexts").alias("contexts")
    )
