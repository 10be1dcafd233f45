"""DuckDB SQL for the queries of the catalogue; rows of fixtures are derived by hand from the operators' definitions."""

from __future__ import annotations

from motif.functions.exprs import KEYWORDS, OTHER_CATEGORIES
from motif.operators.search import STOP_WORDS
from motif.schema import CATEGORIES


#: What tfidf_search looks for, and how many rows it returns.
SEARCHED, K = "thntent ouen tion les", 10
#: What index_search looks for; the last one has no word of the features.
ASKED = (SEARCHED, "the and of tion", "la que", "!")


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_MARKED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '''[^'']*''', '''STR''', 'g'), '"[^"]*"', '"STR"', 'g'),
    '`[^`]*`', '`STR`', 'g'), '\b\d+\.?\d*\b', 'NUM', 'g')"""
HASHES = rf"""
tokens AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM
  (SELECT doc_id, regexp_extract_all({_MARKED}, '[a-zA-Z_$][a-zA-Z0-9_$]*|[^\s]') AS t FROM documents)),
named AS (SELECT *, regexp_matches(tok, '^[a-zA-Z_$]') AND tok NOT IN ({_quoted(KEYWORDS)}) AS is_name FROM tokens),
firsts AS (SELECT doc_id, tok, min(pos) AS first FROM named WHERE is_name GROUP BY ALL),
ids AS (SELECT doc_id, tok, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS id FROM firsts),
joined AS (SELECT n.doc_id, string_agg(CASE WHEN is_name THEN '_v' || id ELSE n.tok END, ' ' ORDER BY pos) AS s
  FROM named n LEFT JOIN ids i ON n.doc_id = i.doc_id AND n.tok = i.tok GROUP BY n.doc_id),
hashes AS (SELECT d.*, substr(sha256(coalesce(j.s, '')), 1, 16) AS token_hash FROM documents d LEFT JOIN joined j USING (doc_id))"""

_UNITS = """
firsts AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS name, min(event_id) AS place FROM events GROUP BY ALL),
units AS (SELECT min(place) OVER (PARTITION BY user_id, day) AS seq, user_id || '/' || day AS path, row_number() OVER (PARTITION BY user_id, day ORDER BY place) - 1 AS unit_pos, name FROM firsts),
files AS (SELECT seq, path, list(name ORDER BY unit_pos) AS names, list_sort(list(name)) AS sorted FROM units GROUP BY ALL)"""
_CHAINS = """
chains AS (SELECT u.seq, u.path, u.unit_pos, list_slice(f.names, u.unit_pos + 1, u.unit_pos + 6) AS chain FROM units u JOIN files f USING (seq, path))"""

def _tfidf(stops: list[str], searched: str, k: int) -> str:
    terms = lambda text: rf"""(SELECT list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{_quoted(stops)}], w)))"""
    return rf"""
WITH docs AS (SELECT conv_id * 1000 + turn AS id, {terms("coalesce(text, '')")} AS w FROM conversations),
q AS (SELECT {terms(f"'{searched}'")} AS w),
occ AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM docs),
tf AS (SELECT id, term, count(*) AS tf FROM occ GROUP BY ALL),
feat AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 512),
wts AS (SELECT id, term, tf * idf AS w FROM tf JOIN feat USING (term)),
norm AS (SELECT id, sqrt(sum(w * w)) AS n FROM wts GROUP BY id),
qocc AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM q),
qw AS (SELECT term, count(*) * any_value(idf) AS w FROM qocc JOIN feat USING (term) GROUP BY term),
hits AS (SELECT id, round(sum(wts.w / n * qw.w / (SELECT sqrt(sum(w * w)) FROM qw)), 6) AS score FROM wts JOIN qw USING (term) JOIN norm USING (id) GROUP BY id)
SELECT docs.id, coalesce(score, 0.0) AS score FROM docs LEFT JOIN hits USING (id) ORDER BY score DESC, docs.id LIMIT {k}"""


def kept_search(turns: str, asked: list[tuple[str, str]], k: int, stops: list[str] = STOP_WORDS) -> str:
    """CTEs up to r (query, id, score, rank) of the first k turns (id, fitted, text) for each of asked (query in SQL, text).

    The model is that of the turns that are fitted; the others are weighed by it. Rows without a hit follow in order of id.
    """
    terms = lambda text: rf"""(SELECT list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{_quoted(stops)}], w)))"""
    texts = ", ".join(f"({q}, '{t}')" for q, t in asked)
    occ = lambda key, table: f"SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {table}"
    return rf"""
WITH turns AS ({turns}), docs AS (SELECT id, fitted, {terms("text")} AS w FROM turns),
q AS (SELECT query, {terms("t")} AS w FROM (VALUES {texts}) AS v(query, t)),
tf AS (SELECT id, term, count(*) AS tf FROM ({occ("id", "docs")}) GROUP BY ALL),
feat AS (SELECT term, ln((1 + (SELECT count(*) FROM docs WHERE fitted)) / (1 + count(*))) + 1 AS idf FROM tf JOIN docs USING (id) WHERE fitted GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 512),
wts AS (SELECT id, term, tf * idf AS w FROM tf JOIN feat USING (term)),
norm AS (SELECT id, sqrt(sum(w * w)) AS n FROM wts GROUP BY id),
qw AS (SELECT query, term, count(*) * any_value(idf) AS w FROM ({occ("query", "q")}) JOIN feat USING (term) GROUP BY ALL),
qn AS (SELECT query, sqrt(sum(w * w)) AS n FROM qw GROUP BY query),
hits AS (SELECT query, id, round(sum(wts.w / norm.n * qw.w / qn.n), 6) AS score FROM wts JOIN qw USING (term) JOIN norm USING (id) JOIN qn USING (query) GROUP BY ALL),
a AS (SELECT q.query, docs.id, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY q.query ORDER BY coalesce(score, 0.0) DESC, docs.id) AS rank
  FROM q CROSS JOIN docs LEFT JOIN hits ON hits.query = q.query AND hits.id = docs.id),
r AS (SELECT query, id, score, CAST(rank AS INT) AS rank FROM a WHERE rank <= {k})"""


def _category(x: str) -> str:
    low = f"regexp_replace(lower({x}), '[/ -]', '_', 'g')"
    inside = sorted(CATEGORIES, key=lambda c: (-len(c), c))
    cases = [f"WHEN {x} IN ({_quoted(CATEGORIES)}) THEN {x}"]
    cases += [f"WHEN contains({low}, '{c}') THEN '{c}'" for c in inside]
    cases += [f"WHEN contains('{c}', {low}) THEN '{c}'" for c in sorted(CATEGORIES)]
    cases += [f"WHEN {low} = '{a}' THEN '{b}'" for a, b in OTHER_CATEGORIES.items()]
    return f"CASE {' '.join(cases)} ELSE 'io' END"


_BOUND = r"""
WITH e AS (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT 1000000 + item_id, substr(text, 1, length(text) * 4 // 5) FROM benchmark),
t AS (SELECT id, regexp_extract_all(text, '[a-zA-Z_]+|[^\s\p{L}\p{N}_]') AS toks FROM e),
s AS (SELECT id, len(toks) AS n FROM t WHERE len(toks) > 0),
c AS (SELECT id, tok, count(*) AS c FROM (SELECT id, unnest(toks) AS tok FROM t) GROUP BY ALL),
o AS (SELECT a.id AS new_id, b.id AS old_id, CAST(sum(least(a.c, b.c)) AS BIGINT) AS overlap FROM c a JOIN c b ON a.tok = b.tok AND a.id > b.id GROUP BY ALL)
SELECT new_id, old_id, x.n AS n_new, y.n AS n_old, overlap FROM o JOIN s x ON x.id = new_id JOIN s y ON y.id = old_id WHERE 2 * overlap >= 0.85 * (x.n + y.n)"""

# The fixed text of a prompt around its variable parts.
_PROMPT = (
    "'Turn this Python code into one reusable, typed function.' || chr(10) || 'Kind: function' || chr(10) || 'Language: python' || chr(10) || 'Observed: ' || n_chars || ' times, in ' || source || '; ' || lang || '; x' || chr(10) || "
    "'Answer with one JSON object with the fields skill_name, category, description, tags, code, usage_example, complexity, composes_with, parameters.' || chr(10) || 'Code:' || chr(10) || substr(text, 1, 3000)"
)

ORACLES = {
    "token_hash": f"WITH {HASHES} SELECT doc_id, token_hash FROM hashes",
    "promote_kth": f"""WITH {HASHES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY token_hash ORDER BY doc_id) AS r FROM hashes)
        SELECT token_hash AS key, count(*) AS frequency, max(CASE WHEN r = 1 THEN doc_id END) AS first_doc, max(CASE WHEN r = 1 THEN source END) AS first_source,
        max(CASE WHEN r = 2 THEN doc_id END) AS kth_doc, max(CASE WHEN r = 2 THEN lang END) AS lang, string_agg(source, ',' ORDER BY r) AS contexts
        FROM ranked WHERE r <= 2 GROUP BY token_hash HAVING count(*) = 2""",
    "promote_events": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
        SELECT user_id, count(*) AS frequency, min(event_id) AS first_event, max(event_id) AS kth_event, string_agg(event_type, ',' ORDER BY r) AS types
        FROM r WHERE r <= 3 GROUP BY user_id HAVING count(*) = 3""",
    "ext_language": r"""WITH p AS (SELECT page_id AS id, url AS path FROM pages UNION ALL
        SELECT p_partkey, 'src/' || p_brand || '/' || list_extract(['a.py', 'b.JS', 'c/d.tsx', 'e.ts', 'f.jsx', 'g.txt', '.py', 'x.py/y'], p_size % 8 + 1) FROM part),
        e AS (SELECT id, path, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS x FROM p)
        SELECT id, path, CASE x WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'jsx' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' END AS language FROM e""",
    "snapshot_diff": """WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice - 1 ELSE o_totalprice END AS m FROM orders WHERE o_orderstatus = 'F')
        SELECT CAST(o_orderkey AS VARCHAR) AS path, o_totalprice AS mtime FROM orders LEFT JOIN b ON k = o_orderkey WHERE m IS NULL OR m <> o_totalprice""",
    "glob_filter": "SELECT page_id, url FROM pages WHERE NOT (url LIKE '%/en/%' OR url LIKE '%example.net%' OR url LIKE 'http://m._____.%')",
    "debounce_session": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
        SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, count(*) AS n FROM s GROUP BY user_id, session""",
    "regex_complexity": "WITH h AS (SELECT page_id, coalesce(html, '') AS t FROM pages) SELECT page_id, CAST(1 + "
    + " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bswitch\b", r"\bcatch\b", r"\bcase\b", r"\?\?", r"\?\.", r"\btry\b", "&&", r"\|\|", r"\?"))
    + r" - len(regexp_extract_all(t, '\?=')) AS DOUBLE) AS complexity FROM h",
    "bracket_balance": r"SELECT page_id, abs(len(regexp_extract_all(coalesce(html, ''), '[{(\[]')) - len(regexp_extract_all(coalesce(html, ''), '[})\]]'))) <= 1 AS balanced FROM pages",
    "abstract_signature": "SELECT conv_id, array_to_string(list_slice(list(role ORDER BY turn, role), 1, 6), ' → ') AS signature FROM conversations GROUP BY conv_id",
    "unit_classify": """WITH u AS (SELECT p_partkey, CASE WHEN p_size < 15 THEN 'use' WHEN p_size < 30 THEN '' ELSE 'get' END || upper(p_type[1]) || lower(p_type[2:]) AS name,
        p_name || CASE WHEN p_retailprice < 950 THEN '</a>' WHEN p_retailprice < 1000 THEN ' => 1' ELSE '' END AS text, p_brand = 'Brand#1' AS declared FROM part)
        SELECT p_partkey, CASE WHEN regexp_matches(name, '^use[A-Z]') THEN 'hook' WHEN regexp_matches(name, '^[A-Z]') AND (contains(text, '<') OR contains(text, 'jsx')) THEN 'component'
        WHEN contains(text, '=>') AND NOT declared THEN 'arrow_fn' ELSE 'function' END AS node_type FROM u""",
    "fuzzy_tokens": r"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-zA-Z_]+|[^\s\p{L}\p{N}_]') AS t FROM documents)""",
    "fuzzy_bound": _BOUND,
    "cooccur_sets": f"""WITH {_UNITS}, r AS (SELECT sorted, path, row_number() OVER (PARTITION BY sorted ORDER BY seq) AS r FROM files WHERE len(sorted) >= 2)
        SELECT array_to_string(sorted, ',') AS names, count(*) AS n, string_agg(path, ',' ORDER BY r) FILTER (r <= 5) AS contexts FROM r GROUP BY sorted""",
    "call_chain": f"WITH {_UNITS}, {_CHAINS} SELECT path, CAST(unit_pos AS INT) AS unit_pos, array_to_string(chain, ',') AS chain FROM chains",
    "call_chain_joined": """WITH RECURSIVE u AS (SELECT o_orderpriority AS path, o_orderkey AS unit_pos, CAST(o_custkey AS VARCHAR) AS name,
          unnest([CAST(o_custkey * 7 % 1000 + 1 AS VARCHAR), CAST(o_custkey + 1 AS VARCHAR), CAST(o_orderkey % 50 AS VARCHAR)]) AS called, unnest([1, 2, 3]) AS place FROM orders),
        n AS (SELECT DISTINCT path, name FROM u),
        l AS (SELECT u.path, unit_pos, u.name, coalesce(list(called ORDER BY place) FILTER (n.name IS NOT NULL), []) AS local FROM u LEFT JOIN n ON n.path = u.path AND n.name = called GROUP BY ALL),
        t AS (SELECT path, name, max_by(local, unit_pos) AS local FROM l GROUP BY ALL),
        w AS (SELECT path, unit_pos, [name] AS chain, list_filter(local, lambda c: c <> name) AS ahead FROM l
          UNION ALL SELECT w.path, unit_pos, list_append(chain, ahead[1]), list_filter(t.local, lambda c: NOT list_contains(list_append(chain, ahead[1]), c))
          FROM w JOIN t ON t.path = w.path AND t.name = ahead[1] WHERE len(ahead) > 0 AND len(chain) <= 5)
        SELECT path, unit_pos, array_to_string(max_by(chain, len(chain)), ',') AS chain FROM w GROUP BY path, unit_pos""",
    "composition_dedup": f"""WITH {_UNITS}, {_CHAINS},
        ev AS (SELECT 0 AS kind, seq, path, -1 AS unit_pos, sorted AS key FROM files WHERE len(sorted) >= 2
          UNION ALL SELECT 1, c.seq, c.path, unit_pos, chain FROM chains c JOIN files f ON f.path = c.path WHERE len(chain) >= 2 AND len(f.names) >= 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY seq, path, unit_pos) AS r FROM ev),
        p AS (SELECT kind, key, string_agg(path, ',' ORDER BY r) FILTER (r <= 2) AS contexts, max(CASE WHEN r = 2 THEN seq END) AS seq, max(CASE WHEN r = 2 THEN unit_pos END) AS unit_pos FROM r GROUP BY ALL HAVING count(*) >= 2),
        o AS (SELECT *, row_number() OVER (PARTITION BY list_sort(key) ORDER BY seq, kind, unit_pos) AS o FROM p)
        SELECT CASE kind WHEN 1 THEN array_to_string(list_slice(key, 1, 3), '_to_') ELSE array_to_string(list_slice(key, 1, 3), '_and_') END AS name, array_to_string(key, ',') AS components,
        CASE kind WHEN 1 THEN 'pipeline' ELSE 'co_occurrence' END AS pattern_type, CAST(2 AS BIGINT) AS frequency, contexts FROM o WHERE o = 1""",
    "compositions_fixture": """SELECT * FROM (VALUES ('a_and_b_and_c', 'a,b,c', 'co_occurrence', CAST(2 AS BIGINT), 'x.py,y.py', ''),
        ('b_to_c', 'b,c', 'pipeline', CAST(2 AS BIGINT), 'x.py,y.py', 'b,c')) t(name, components, pattern_type, frequency, contexts, call_chain)""",
    "keyword_search": """WITH p AS (SELECT p_partkey, p_name || ' ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS label, p_type, p_brand, string_split(p_name, ' ') AS tags FROM part),
        s AS (SELECT p_partkey, label, round(0.8 * CAST(contains(lower(label), 'ring') AS INT) + 0.5 * CAST(contains(lower(p_type), 'ring') AS INT)
        + 0.3 * len(list_filter(tags, lambda t: contains(lower(t), 'ring'))) + 0.2 * CAST(contains(lower(p_brand), 'ring') AS INT), 6) AS score FROM p)
        SELECT p_partkey, label, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, label LIMIT 50""",
    "tfidf_search": _tfidf(STOP_WORDS, SEARCHED, K),
    "index_search": kept_search("SELECT conv_id * 1000 + turn AS id, role = 'user' AS fitted, coalesce(text, '') AS text FROM conversations", [(f"CAST({i} AS INT)", t) for i, t in enumerate(ASKED)], K) + " SELECT * FROM r",
    "hash_embed": r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents),
        b AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 31, 2)) AS INT) AS bucket, count(*) AS c FROM w GROUP BY ALL)
        SELECT doc_id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""",
    "fuzzy_ratio_fixture": "SELECT CAST(id AS BIGINT) AS id, CAST(ratio AS DOUBLE) AS ratio FROM (VALUES (1, 0.666667), (2, 0.25), (3, 0.5), (4, 1.0), (5, 0.0), (6, 0.0)) AS t(id, ratio)",
    "fuzzy_rekey_fixture": "SELECT CAST(seq AS BIGINT) AS seq, structural_hash, new_hash FROM (VALUES (1, 'h1', 'h1'), (2, 'h2', 'h1'), (3, 'h3', 'h3'), (4, 'h2', 'h1')) AS t(seq, structural_hash, new_hash)",
    "candidate_files": """SELECT true AS named, 'python' AS language, CAST(2 AS BIGINT) AS frequency, '["a.py","b.py"]' AS contexts""",
    "skill_pages": """SELECT * FROM (VALUES
        ('load_json', 'name: load-json', 'description: Reads json Use for "load json", "json", "file". Seen 12 times.', '```'),
        ('save_json', 'name: save-json', 'description: Writes json Use for "save json", "json", "file", "disk". Seen 5 times.', '```'),
        ('fetch_page', 'name: fetch-page', 'description: Fetches a page Use for "fetch page", "http". Seen 1 times.', '```')) AS t(skill_name, named, described, last)""",
    "decorators_and_sources": """SELECT * FROM (VALUES ('a.py', 'f', 'cache,route(''/x'')'), ('a.py', 'g', ''), ('b.ts', 'Box', '@sealed')) AS t(path, name, decorators)""",
    "composition_candidates": """SELECT * FROM (VALUES ('a → b → c', CAST(5.0 AS DOUBLE), 'composed', CAST(3 AS BIGINT), 'x.py'), ('b → c', CAST(5.0 AS DOUBLE), 'composed', CAST(2 AS BIGINT), 'x.py'))
        AS t(abstract_signature, complexity_score, node_type, parts, first_seen_file)""",
    "skill_search_auto": "SELECT 'fetch_page' AS skill_name",
    "cosine_topk": """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
        s AS (SELECT query, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM s) SELECT query, vec_id, score FROM r WHERE r <= 5""",
    "related_tags": """WITH t AS (SELECT p_partkey AS name, list_sort(list_distinct(string_split(p_name || ' ' || p_type, ' '))) AS tags FROM part),
        c AS (SELECT DISTINCT tags FROM t), m AS (SELECT tags, unnest(tags) AS tag FROM c),
        p AS (SELECT a.tags, b.tags AS other, count(*) AS overlap FROM m a JOIN m b ON a.tag = b.tag GROUP BY ALL),
        f AS (SELECT *, row_number() OVER (PARTITION BY tags ORDER BY name) AS place FROM t),
        x AS (SELECT t.name, f.name AS related_name, overlap FROM t JOIN p ON p.tags = t.tags JOIN f ON f.tags = p.other AND f.place <= 4 WHERE t.name <> f.name),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY overlap DESC, related_name) AS rank FROM x)
        SELECT name, related_name, overlap, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""",
    "category_stats": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "language_stats": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "category_languages": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(*) AS n FROM documents GROUP BY source",
    "library_totals": "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total_frequency FROM part",
    "top_frequency": "SELECT s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 5",
    "sorted_list": "SELECT s_name, CASE WHEN length(s_name) > 12 THEN substr(s_name, 1, 12) || '…' ELSE s_name END AS short FROM supplier",
    "category_filter": "SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY'",
    "point_get": "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_name = 'Supplier#000000003'",
    "maturity": "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 10 THEN 'mature' WHEN count(*) >= 5 THEN 'established' ELSE 'emerging' END AS maturity FROM orders GROUP BY o_custkey",
    "upsert_latest": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type FROM r WHERE r = 1",
    "legacy_merge": """WITH a AS (SELECT s_nationkey AS nation, min(s_name) AS name FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS nation, min(c_name) AS name FROM customer GROUP BY 1)
        SELECT * FROM a UNION ALL SELECT * FROM b WHERE nation NOT IN (SELECT nation FROM a)""",
    "dependency_edges": "SELECT unnest(string_split(p_name, ' ')) AS dependency, p_name AS skill_name FROM (SELECT DISTINCT p_name FROM part)",
    "unescape_code": r"""WITH c AS (SELECT doc_id, CASE WHEN contains(coalesce(text, ''), chr(10)) THEN text ELSE coalesce(text, '') || '\n\t\"x\''' END AS c FROM documents),
        n AS (SELECT doc_id, CASE WHEN contains(c, '\n') AND NOT contains(c, chr(10)) THEN replace(c, '\n', chr(10)) ELSE c END AS c FROM c),
        t AS (SELECT doc_id, CASE WHEN contains(c, '\t') AND NOT contains(c, chr(9)) THEN replace(c, '\t', chr(9)) ELSE c END AS c FROM n)
        SELECT doc_id, sha256(replace(replace(c, '\"', '"'), '\''', '''')) AS code_sha256 FROM t""",
    "kebab_name": """SELECT p_partkey, replace(p_name, ' ', '-') AS kebab,
        array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, CASE WHEN p_size < 20 THEN 'tsx' ELSE 'py' END AS ending FROM part""",
    "prompt_build": f"SELECT doc_id, sha256({_PROMPT}) AS prompt_sha256 FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL",
    "json_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "unwrap_response": "SELECT event_id, CASE WHEN value < 20 THEN event_type END AS skill_name FROM events",
    "category_normalise": "WITH c AS (SELECT p_partkey, list_extract(['io', 'Data Transform', 'http', 'error-handling', 'database', 'nonsense', 'api_client/rest', 'auth', 'UI', 'string_utils_x'], p_partkey % 10 + 1) AS c FROM part) "
    f"SELECT p_partkey, {_category('c')} AS category FROM c",
    "composite_key": "SELECT p_partkey, 'composed_' || substr(sha256(replace(p_name, ' ', chr(1))), 1, 8) AS key FROM part",
    "py_units": """SELECT path, CAST(unit_pos AS INT) AS unit_pos, name, node_type, calls, CAST(line_start AS INT) AS line_start, CAST(n_lines AS INT) AS n_lines FROM (VALUES
        ('a.py', 0, 'load_config', 'function', 'open,json.load,RuntimeError', 1, 7), ('b.py', 0, 'read_settings', 'function', 'open,json.load,RuntimeError', 1, 7),
        ('c.py', 0, 'A', 'class', 'inner,helper', 1, 4), ('c.py', 1, 'top', 'function', 'A().m,A', 7, 1), ('c.py', 2, 'm', 'function', 'inner,helper', 2, 3),
        ('c.py', 3, 'inner', 'function', 'helper', 3, 1)) t(path, unit_pos, name, node_type, calls, line_start, n_lines)""",
    "js_units": """SELECT path, CAST(unit_pos AS INT) AS unit_pos, name, node_type, exports, calls, CAST(line_start AS INT) AS line_start, CAST(n_lines AS INT) AS n_lines FROM (VALUES
        ('a.ts', 0, 'useThing', 'hook', true, 'fetchIt', 1, 2), ('b.jsx', 0, 'Card', 'component', false, 'format', 1, 2), ('c.js', 0, 'add', 'arrow_fn', false, '', 1, 0),
        ('c.js', 1, 'plain', 'function', false, 'add,Math.max', 2, 2), ('c.js', 2, 'Box', 'class', false, 'plain', 5, 2)) t(path, unit_pos, name, node_type, exports, calls, line_start, n_lines)""",
    "py_candidates": """SELECT * FROM (VALUES ('a.py', CAST(2 AS BIGINT), CAST(4 AS DOUBLE), 'open → json.load → RuntimeError', 'a.py,b.py')) t(first_seen_file, frequency, complexity_score, abstract_signature, contexts)""",
    "py_complexity": """SELECT CAST(id AS BIGINT) AS id, CAST(complexity AS DOUBLE) AS complexity, valid FROM (VALUES (1, 1, true), (2, 1, true), (3, 1, true), (4, 1, true), (5, 1, true),
        (6, 1, true), (7, 1, true), (8, 1, true), (9, 1, false), (10, 3, true), (11, 4, true), (12, 4, true)) t(id, complexity, valid)""",
    "py_hash_classes": """SELECT CAST(id AS BIGINT) AS id, CAST(first_id AS BIGINT) AS first_id FROM (VALUES (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (10, 10), (11, 11), (12, 11)) t(id, first_id)""",
    "submit_code": "SELECT 'manual_submission.py' AS first_seen_file, CAST(2 AS BIGINT) AS frequency, 'manual_submission.py,editor.py' AS contexts",
    "editor_rules": """SELECT * FROM (VALUES ('fetch_page', '- `fetch-page` — Fetches a page [api_client] '), ('load_json', '- `load-json` — Reads json [io] 🐍'),
        ('save_json', '- `save-json` — Writes json [io] ⚛️')) t(skill_name, line)""",
    "skill_search": "SELECT skill_name, CAST(score AS DOUBLE) AS score FROM (VALUES ('load_json', 1.8), ('save_json', 1.8)) t(skill_name, score)",
    "skill_tree": """SELECT s || f AS path FROM (VALUES ('load-json/', 'load_json.py'), ('save-json/', 'save_json.tsx'), ('fetch-page/', 'fetch_page.py')) t(s, c),
        LATERAL (SELECT unnest(['SKILL.md', 'scripts/' || c, 'references/examples.md', 'meta.json']) AS f)""",
    "json_repair": """SELECT CAST(id AS BIGINT) AS id, skill_name, category, code, tags FROM (VALUES (1, 'load_json', 'io', 'x = 1', 'a,b'), (2, 'fetch', 'api_client', 'line1' || chr(10) || 'line2', ''),
        (3, 'tick', 'io', 'a = "q"', ''), (6, 'cut', 'io', 'y = 2', 'z')) t(id, skill_name, category, code, tags)""",
    "stream_promote": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
        SELECT user_id, count(*) AS frequency, max(event_id) AS kth_event, string_agg(event_type, ',' ORDER BY r) AS types FROM r WHERE r <= 3 GROUP BY user_id HAVING count(*) = 3""",
}
# The stream over the same files finds the same compositions.
ORACLES["stream_compositions"] = ORACLES["composition_dedup"]
# The same rows by a stream of looks.
ORACLES["snapshot_stream"] = ORACLES["snapshot_diff"]
