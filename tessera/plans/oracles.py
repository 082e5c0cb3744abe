"""DuckDB SQL for each query of `queries`."""

from __future__ import annotations

from ..functions import callsites as cs
from ..functions import paths as pt
from ..functions.rules import sql
from .adapters import CALLS_SQL, CHAIN_EDGES_SQL, GROUP_FILES_SQL, PATHS_SQL, picked_sql


def listed(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def mapped(value: str, names: dict[str, str], otherwise: str = "NULL") -> str:
    cases = " ".join(f"WHEN {value} = '{k}' THEN '{v}'" for k, v in names.items())
    return f"(CASE {cases} ELSE {otherwise} END)"


_LOWER, _NAME = "lower(path)", "split_part(lower(path), '/', -1)"
_EXT = f"split_part({_NAME}, '.', -1)"
_PAGES = listed(pt.DOCUMENT_EXTENSIONS)


def _landing(section: str) -> str:
    rest = f"substr({_LOWER}, {len(section) + 1})"
    return f"(starts_with({_LOWER}, '{section}') AND NOT contains({rest}, '/') AND split_part({rest}, '.', -1) IN {_PAGES})"


TOP_DOC = (
    f"({_LOWER} IN {listed(pt.API_PAGES)} OR {' OR '.join(map(_landing, pt.LANDING_SECTIONS))}"
    f" OR (NOT contains(path, '/') AND {sql('path', pt.ROOT_DOCUMENTS)}) OR {sql('path', pt.ANYWHERE_DOCUMENTS)})"
)
CONFIG_LIKE = (
    f"({sql('path', pt.CONFIG_LIKE)} OR (contains({_LOWER}, '/themes/') AND starts_with({_NAME}, 'theme-'))"
    f" OR (contains({_LOWER}, '/fixtures/') AND NOT contains({_LOWER}, '/src/')))"
)
CATEGORY = f"""(CASE
  WHEN {sql('path', pt.ENVIRONMENT + pt.APPLICATION_CONFIG)} THEN 'Infrastructure'
  WHEN ends_with({_NAME}, '.sql') AND (contains({_LOWER}, '/resources/db/') OR starts_with({_LOWER}, 'db/')) THEN 'Migration'
  WHEN {sql('path', pt.SCHEMAS)} THEN 'Schema' WHEN {sql('path', pt.MIGRATIONS)} THEN 'Migration'
  WHEN {sql('path', pt.SCRIPTS)} THEN 'Script' WHEN {sql('path', pt.DEPLOYMENT)} THEN 'Deployment'
  WHEN NOT {sql('path', pt.SITE_CONTENT)} AND NOT ({_EXT} IN ('md', 'mdx') AND {sql('path', pt.INLINE_DOCUMENT_PLACES)}) AND {sql('path', pt.DOCUMENTS)} THEN 'Documentation'
  WHEN {sql('path', pt.LINT)} THEN 'Lint' WHEN {sql('path', pt.TEST_UTILITIES)} THEN 'TestUtil'
  WHEN {sql('path', pt.GENERATED)} THEN 'Generated' ELSE 'Unclassified' END)"""
ROLE = "(CASE " + " ".join(f"WHEN {' OR '.join(f'contains({_LOWER}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in pt.ROLES) + " ELSE 'Infrastructure' END)"
_STEM_OF_NAME = f"regexp_replace({_NAME}, '\\.[^.]*$', '')"
TEST_FILE = f"({sql('path', pt.TEST_FILES)} OR regexp_matches({_STEM_OF_NAME}, '(test|tests|spec)$'))"
_LAST_EXT = "split_part(path, '.', -1)"


def _unmarked(name: str, marks) -> str:
    for m in marks:
        name = f"replace({name}, '{m}', '.')"
    return name


_RAW_NAME = "split_part(path, '/', -1)"
_BARE = f"regexp_replace(lower(regexp_replace(regexp_replace({_unmarked(_RAW_NAME, pt.TEST_MARKS[:-1])}, '\\.[^.]*$', ''), '^test_', '')), '(tests|test|spec)$', '')"
BARE_STEM = f"(CASE WHEN {_BARE} IN {listed(pt.COMMON_STEMS)} THEN '' ELSE {_BARE} END)"
_CONTEXT = "array_to_string(list_slice(string_split(path, '/'), greatest(len(string_split(path, '/')) - 2, 1), len(string_split(path, '/')) - 1), '/')"
CONTEXT_STEM = f"({_CONTEXT} || ':' || regexp_replace(regexp_replace(regexp_replace({_unmarked(_RAW_NAME, pt.TEST_MARKS)}, '\\.[^.]*$', ''), '^test_', ''), '(Tests|Test|Spec)$', ''))"
_FIXTURE = "regexp_extract(path, '(?i)^((?:.*?/)?fixtures/[^/]+)/', 1)"
_FIXTURE_ALONE = "regexp_extract(path, '(?i)^((?:.*?/)?fixtures)/[^/]+$', 1)"
FIXTURE_ROOT = f"(CASE WHEN {_FIXTURE} <> '' THEN {_FIXTURE} WHEN {_FIXTURE_ALONE} <> '' THEN {_FIXTURE_ALONE} END)"
ROOT_PAGE = f"(NOT {TOP_DOC} AND regexp_matches({_LOWER}, '^docs/[^/]*$') AND split_part({_LOWER}, '.', -1) IN {_PAGES})"
LOCALIZED = f"regexp_matches({_LOWER}, '^docs/[a-z-]{{2,8}}/docs/')"
FALLBACK = f"({sql('path', pt.FALLBACK_DOCS)} OR {ROOT_PAGE})"
PARTITION = f"""(CASE WHEN {CONFIG_LIKE} THEN 'infra:config-like'
  WHEN {CATEGORY} <> 'Unclassified' THEN 'infra:' || {mapped(CATEGORY, pt.CATEGORY_SLUGS)}
  WHEN split_part(path, '/', 1) IN {listed(pt.MONOREPO_ROOTS)} AND split_part(path, '/', 2) IN {listed(pt.CONTAINERS)}
    AND NOT contains(split_part(path, '/', 2), '.') AND split_part(path, '/', 3) <> '' AND NOT contains(split_part(path, '/', 3), '.')
    THEN 'semantic:' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3)
  WHEN split_part(path, '/', 1) IN {listed(pt.MONOREPO_ROOTS)} AND split_part(path, '/', 2) <> '' AND NOT contains(split_part(path, '/', 2), '.')
    THEN 'semantic:' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2)
  ELSE 'semantic:' || split_part(path, '/', 1) END)"""
_RISK_FLAGS = {n: sql("path", r) for n, r in pt.RISK.items()}
FLAGS = f"""flags AS (
  SELECT group_id, bool_or({_RISK_FLAGS['is_schema']}) AS has_schema, bool_or({_RISK_FLAGS['is_api']}) AS has_api,
    bool_or({_RISK_FLAGS['is_auth']}) AS has_auth, bool_and({_RISK_FLAGS['is_test']}) AS is_test_only,
    sum(additions) AS additions, sum(deletions) AS deletions
  FROM group_files GROUP BY group_id
), parts AS (
  SELECT group_id, least(1.0, CASE WHEN has_schema THEN 0.3 ELSE 0 END + CASE WHEN has_api THEN 0.25 ELSE 0 END + CASE WHEN has_auth THEN 0.35 ELSE 0 END) AS risk,
    0.5 AS centrality, least(1.0, ln(1.0 + additions + deletions) / ln(1001.0)) AS surface_area,
    CASE WHEN is_test_only THEN 0.3 ELSE 0.5 END AS uncertainty, additions, deletions
  FROM flags
)"""
_METHOD = "split_part(callee, '.', -1)"
_RECEIVER = "(CASE WHEN contains(callee, '.') THEN regexp_replace(callee, '\\.[^.]*$', '') END)"


def _some(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _begins(names, following) -> str:
    return "(" + " OR ".join(f"callee = '{n}' OR " + " OR ".join(f"starts_with(callee, '{n}{f}')" for f in following) for n in names) + ")"


DATABASE = f"coalesce(strlen({_RECEIVER}) > 1 AND lower({_RECEIVER}) NOT IN {listed(cs.OTHER_RECEIVERS)} AND {_some(f'lower({_RECEIVER})', cs.DATABASE_WORDS)}, false)"
_MEMBER = "contains(callee, '.')"
PATTERN = f"""(CASE WHEN callee IN {listed(cs.LOG_CALLS)} THEN 'Logging'
  WHEN starts_with(callee, 'process.env') OR starts_with(callee, 'os.environ') OR {_begins(cs.CONFIG_READS, ('.', '['))} THEN 'ConfigRead'
  WHEN {_begins(cs.HTTP_CALLS, ('.',))} THEN 'HttpCall'
  WHEN {_METHOD} IN {listed(cs.COLLECTION_METHODS)} OR callee IN {listed(cs.LIBRARY_CALLS)} THEN NULL
  WHEN {_MEMBER} AND {_METHOD} IN {listed(cs.EMIT_METHODS)} THEN 'EventEmission'
  WHEN {_MEMBER} AND {_METHOD} IN {listed(cs.HANDLE_METHODS)} THEN 'EventHandling'
  WHEN ({_MEMBER} AND {_METHOD} IN {listed(cs.WRITE_METHODS)} AND {DATABASE}) OR {_some('lower(callee)', cs.WRITE_WORDS)} THEN 'Persistence'
  WHEN ({_MEMBER} AND {_METHOD} IN {listed(cs.READ_METHODS)} AND {DATABASE}) OR {_some('lower(callee)', cs.READ_WORDS)} THEN 'DatabaseRead' END)"""
CONFIDENCE = f"""(CASE WHEN pattern = 'Logging' THEN 0.95 WHEN pattern = 'ConfigRead' THEN 0.9 WHEN pattern = 'HttpCall' THEN 0.85
  WHEN pattern IN ('EventEmission', 'EventHandling') THEN 0.8 WHEN {_some('lower(callee)', cs.MAPPER_WORDS)} THEN 0.95
  WHEN {_some("split_part(lower(callee), '.', 1)", cs.SURE_RECEIVERS)} THEN 0.9 WHEN {_some('lower(callee)', cs.WRITE_WORDS + cs.READ_WORDS)} THEN 0.95 ELSE 0.7 END)"""
HEURISTIC = f"""{CALLS_SQL}, told AS (SELECT *, {PATTERN} AS pattern FROM calls), heuristic AS (
  SELECT CASE WHEN containing_function IS NULL THEN path ELSE path || '::' || containing_function END AS from_symbol, path AS file, pattern,
    CAST({CONFIDENCE} AS DOUBLE) AS confidence, callee AS evidence, line FROM told WHERE pattern IS NOT NULL
)"""
_UNDIRECTED = "both_ways AS (SELECT src AS a, dst AS b FROM chain UNION SELECT dst, src FROM chain)"
_SOURCES = ("./user.service", "../../db/schema", ".models", "..core.users", "...", "react", "./index")
_UNIT = "unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_SIMILAR = f"""{_UNIT}, pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS similarity
  FROM unit x JOIN unit y ON x.vec_id < y.vec_id
)"""
_RGB = {i: (pt_low, pt_mid, pt_high) for i, (pt_low, pt_mid, pt_high) in enumerate(((166, 250, 243), (227, 179, 139), (161, 135, 168)))}


def _channel(i: int) -> str:
    low, mid, high = _RGB[i]
    return f"CAST(CAST(CASE WHEN risk <= 0.5 THEN floor({low} + ({mid - low}) * (risk / 0.5) + 0.5) ELSE floor({mid} + ({high - mid}) * ((risk - 0.5) / 0.5) + 0.5) END AS BIGINT) AS VARCHAR)"


ORACLES = {
    "rank_review_groups": f"""WITH {GROUP_FILES_SQL}, {FLAGS}, scored AS (
      SELECT group_id, (0.35 * risk + 0.25 * centrality + 0.2 * surface_area + 0.2 * uncertainty) / 1.0 AS s FROM parts
    ) SELECT group_id, round(s, 9) AS composite_score, CAST(row_number() OVER (ORDER BY round(s, 12) DESC, group_id) AS INTEGER) AS review_order FROM scored""",
    "group_risk_flags": f"WITH {GROUP_FILES_SQL}, {FLAGS} SELECT group_id, has_schema, has_api, has_auth, is_test_only FROM flags",
    "path_categories": f"""WITH {PATHS_SQL} SELECT doc_id, path, {CATEGORY} AS category, {mapped(CATEGORY, pt.CATEGORY_LABELS)} AS label,
      {sql('path', pt.ENVIRONMENT)} AS infrastructure, {CONFIG_LIKE} AS config_like, {TOP_DOC} AS top_level_doc, {ROLE} AS role, {TEST_FILE} AS test_file,
      {mapped(_LAST_EXT, pt.LANGUAGES, "'Unknown'")} AS language, lower({_LAST_EXT}) IN {listed(pt.SOURCE_EXTENSIONS)} AS source_extension,
      lower({_LAST_EXT}) IN {listed(pt.NATIVE_EXTENSIONS)} AS native_source, {', '.join(f'{r} AS {n}' for n, r in _RISK_FLAGS.items())} FROM paths""",
    "path_stems": f"""WITH {PATHS_SQL} SELECT doc_id, {BARE_STEM} AS bare_stem, {CONTEXT_STEM} AS contextual_stem, regexp_replace(path, '/[^/]*$', '') AS parent,
      split_part({_RAW_NAME}, '.', 1) AS file_stem, CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END AS prefix_2,
      split_part(path, '/', -2) || '/' || {_RAW_NAME} AS short_label, {FIXTURE_ROOT} AS fixture_root,
      {FIXTURE_ROOT} IS NOT NULL AND lower({_LAST_EXT}) IN {listed(pt.FIXTURE_EXTENSIONS)} AS fixture_source,
      {FIXTURE_ROOT} IS NOT NULL AND ({_NAME} IN {listed(pt.FIXTURE_CONFIGS)} OR (starts_with({_NAME}, 'tsconfig') AND ends_with({_NAME}, '.json'))) AS fixture_config,
      CASE WHEN doc_id % 702 < 26 THEN chr(CAST(65 + doc_id % 702 AS INTEGER)) ELSE chr(CAST(64 + (doc_id % 702) // 26 AS INTEGER)) || chr(CAST(65 + (doc_id % 702) % 26 AS INTEGER)) END AS node_label
      FROM paths""",
    "documentation_candidates": f"""WITH {PATHS_SQL} SELECT doc_id,
      (split_part({_LOWER}, '.', -1) IN {_PAGES} AND NOT {TOP_DOC} AND NOT {LOCALIZED} AND ({sql('path', pt.SEMANTIC_DOCS)} OR {FALLBACK})) AS candidate,
      {FALLBACK} AS fallback, {LOCALIZED} AS localized, {ROOT_PAGE} AS root_page FROM paths""",
    "large_change_partitions": f"""WITH {PATHS_SQL}, keyed AS (SELECT DISTINCT path, {PARTITION} AS bucket FROM paths)
      SELECT bucket, starts_with(bucket, 'infra:') AS is_infra, CAST(count(*) AS INTEGER) AS n_files, string_agg(path, ',' ORDER BY path) AS files FROM keyed GROUP BY bucket""",
    "directory_groups": f"""WITH {PATHS_SQL}, keyed AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS directory FROM paths)
      SELECT directory, split_part(directory, '/', -1) || ' (directory)' AS name, string_agg(path, ',' ORDER BY path) AS files FROM keyed GROUP BY directory""",
    "topic_tokens": f"""WITH {PATHS_SQL}, pieces AS (
      SELECT doc_id, unnest(regexp_extract_all({BARE_STEM} || ' ' || lower(array_to_string(list_slice(string_split(path, '/'), greatest(len(string_split(path, '/')) - 3, 1), len(string_split(path, '/')) - 1), ' ')), '[a-z0-9]+')) AS w FROM paths
    ), words AS (SELECT DISTINCT doc_id, regexp_replace(w, '^[0-9]+', '') AS t FROM pieces)
      SELECT p.doc_id, coalesce(string_agg(t, ',' ORDER BY t), '') AS tokens FROM paths p LEFT JOIN (SELECT * FROM words WHERE strlen(t) >= 3 AND t NOT IN {listed(pt.GENERIC_TOPICS)}) w ON w.doc_id = p.doc_id GROUP BY p.doc_id""",
    "import_paths": f"""WITH {PATHS_SQL}, src AS (SELECT doc_id, path, {picked_sql(_SOURCES, 'doc_id')} AS source FROM paths), parts AS (
      SELECT *, strlen(regexp_extract(source, '^\\.*', 0)) AS dots, regexp_replace(source, '^\\.+', '') AS rest FROM src
    ), dotted AS (
      SELECT *, CASE WHEN dots = 0 THEN source ELSE (CASE WHEN dots = 1 THEN '.' ELSE rtrim(repeat('../', CAST(dots - 1 AS INTEGER)), '/') END)
        || CASE WHEN rest = '' THEN '' ELSE '/' || replace(rest, '.', '/') END END AS dotted FROM parts
    ), walked AS (
      SELECT doc_id, source, dotted, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(regexp_replace(path, '/[^/]*$', '') || '/' || dotted, '/'), lambda x: [x])),
        lambda acc, x: CASE WHEN x[1] IN ('.', '') THEN acc WHEN x[1] = '..' THEN list_slice(acc, 1, len(acc) - 1) ELSE list_concat(acc, x) END) AS done FROM dotted
    ) SELECT doc_id, source, dotted, array_to_string(done, '/') AS target FROM walked""",
    "call_patterns": f"WITH {HEURISTIC} SELECT * FROM heuristic",
    "data_flow_edges": f"""WITH {CALLS_SQL}, base AS (SELECT *, pos % 40 AS v FROM calls)
      SELECT m.callee AS producer, u.callee AS consumer, 'v' || CAST((u.pos - 1) % 40 AS VARCHAR) AS via,
        CASE WHEN u.containing_function IS NULL THEN u.path ELSE u.path || '::' || u.containing_function END AS containing_function, u.path AS file, u.line
      FROM base m JOIN base u ON m.path = u.path AND m.containing_function IS NOT DISTINCT FROM u.containing_function AND m.v = (u.pos - 1) % 40 AND m.callee <> u.callee
      WHERE m.pos % 2 = 0 AND u.pos % 2 = 1""",
    "symbol_changes": """WITH a AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT')
      SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS path, CAST(coalesce(a.o_orderkey, b.o_orderkey) AS VARCHAR) AS name, 'Function' AS kind,
        CASE WHEN a.o_orderkey IS NULL THEN 'Added' WHEN b.o_orderkey IS NULL THEN 'Removed' ELSE 'Modified' END AS change
      FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderkey % 5 = 0""",
    "reachability": f"""WITH RECURSIVE {CHAIN_EDGES_SQL}, walk(seed, node, dist) AS (
      SELECT DISTINCT src, src, 0 FROM chain WHERE src % 50 = 0
      UNION SELECT w.seed, c.dst, w.dist + 1 FROM walk w JOIN chain c ON c.src = w.node WHERE w.dist < 60
    ) SELECT seed, node, CAST(min(dist) AS INTEGER) AS dist FROM walk GROUP BY seed, node""",
    "nearest_group_by_directory": f"""WITH {PATHS_SQL}, {GROUP_FILES_SQL}, f AS (SELECT DISTINCT path FROM paths), g AS (SELECT DISTINCT group_no, path FROM group_files),
      fp AS (SELECT path, n, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS prefix FROM (SELECT path, unnest(range(2, len(string_split(path, '/')) + 1)) AS n FROM f)),
      gp AS (SELECT prefix, min(group_no) AS group_no FROM (SELECT group_no, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS prefix FROM (SELECT group_no, path, unnest(range(2, len(string_split(path, '/')) + 1)) AS n FROM g)) GROUP BY prefix)
      SELECT path, group_no FROM (SELECT fp.path, gp.group_no, row_number() OVER (PARTITION BY fp.path ORDER BY n DESC) AS r FROM fp JOIN gp ON fp.prefix = gp.prefix) WHERE r = 1""",
    "similar_pairs": f"WITH {_SIMILAR} SELECT a, b, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.3",
    "top_similar_pairs": f"WITH {_SIMILAR} SELECT a, b, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.3 ORDER BY pairs.similarity DESC, a, b LIMIT 20",
    "similarity_clusters": f"""WITH RECURSIVE {_SIMILAR}, e AS (SELECT a, b FROM pairs WHERE similarity >= 0.4 UNION SELECT b, a FROM pairs WHERE similarity >= 0.4),
      walk(id, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT w.id, e.b FROM walk w JOIN e ON e.a = w.node),
      named AS (SELECT id, min(node) AS cluster FROM walk GROUP BY id)
      SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM named""",
    "label_centroids": f"""WITH each AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings)
      SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM each GROUP BY label, pos""",
    "regressions": """SELECT user_id, event_id, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous - value > 50""",
    "cache_eviction": """SELECT cache, entry, total FROM (SELECT o_custkey AS cache, o_orderkey AS entry, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM orders) WHERE total <= 500000""",
    "first_detections": f"""WITH {CALLS_SQL} SELECT file, symbol, entrypoint_type FROM (
      SELECT path AS file, coalesce(containing_function, callee) AS symbol, {picked_sql(('TestFile', 'HttpRoute', 'CliCommand'), 'pos')} AS entrypoint_type,
        row_number() OVER (PARTITION BY path, coalesce(containing_function, callee) ORDER BY pos % 9, pos) AS r FROM calls) WHERE r = 1""",
    "grouping_metrics": f"""WITH {PATHS_SQL}, {GROUP_FILES_SQL}, files AS (SELECT group_id, path || '/' || CAST(pos AS VARCHAR) AS path FROM group_files),
      infra AS (SELECT path || '/' || CAST(doc_id AS VARCHAR) AS path FROM paths WHERE {sql('path', pt.ENVIRONMENT)}),
      g AS (SELECT group_id, count(*) AS n FROM files GROUP BY group_id),
      f AS (SELECT path, count(*) AS times, max(i) AS i FROM (SELECT path, 0 AS i FROM files UNION ALL SELECT path, 1 FROM infra) GROUP BY path),
      a AS (SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS grouped_files, count(*) FILTER (WHERE n = 1) AS singletons, max(n) AS largest, avg(n) AS mean_size FROM g),
      b AS (SELECT count(*) AS accounted_files, CAST(sum(times - 1) AS BIGINT) AS duplicates, CAST(sum(i) AS BIGINT) AS infra_files FROM f)
      SELECT groups, grouped_files, singletons, largest, round(mean_size, 9) AS mean_size, accounted_files, duplicates, infra_files,
        round(infra_files / accounted_files, 9) AS infra_ratio, round(singletons / groups, 9) AS singleton_ratio, round(largest / accounted_files, 9) AS largest_ratio, 1.0::DOUBLE AS accounted_ratio FROM a, b""",
    "label_recall": "SELECT round(count(*) FILTER (WHERE d.lang = 'en') / count(*), 9) AS score FROM (SELECT DISTINCT doc_id FROM labels) l JOIN documents d ON d.doc_id = l.doc_id",
    "merged_groups": """WITH files AS (SELECT 'g' || CAST(conv_id % 30 AS VARCHAR) AS g, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS path, role, turn FROM conversations),
      moved AS (SELECT path, CASE WHEN role = 'user' THEN 'g' || CAST(turn % 7 AS VARCHAR) ELSE g END AS g FROM files)
      SELECT CASE g WHEN 'g9' THEN 'g3' WHEN 'g5' THEN 'g11' ELSE g END AS group_id, path FROM moved""",
    "file_level_edges": f"""WITH {HEURISTIC} SELECT file AS from_file, 'ext/' || pattern AS to_file, pattern AS types FROM heuristic GROUP BY file, pattern""",
    "call_receivers": f"WITH {CALLS_SQL} SELECT callee, count(*) AS n, {_METHOD} AS method, {_RECEIVER} AS receiver, {DATABASE} AS database FROM calls GROUP BY callee",
    "group_summaries": f"""WITH {GROUP_FILES_SQL}, {FLAGS} SELECT group_id, CAST(greatest(additions + deletions, 1) AS BIGINT) AS weight, round(CAST(risk AS DOUBLE), 9) AS risk,
      CASE WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.4 THEN 'medium' ELSE 'low' END AS level,
      'rgb(' || {_channel(0)} || ', ' || {_channel(1)} || ', ' || {_channel(2)} || ')' AS colour FROM parts""",
    "connected_components": f"""WITH RECURSIVE {CHAIN_EDGES_SQL}, {_UNDIRECTED}, walk(node, seen) AS (
      SELECT a, a FROM both_ways UNION SELECT w.node, b.b FROM walk w JOIN both_ways b ON b.a = w.seen
    ) SELECT node, min(seen) AS component FROM walk GROUP BY node""",
    "nearest_entrypoints": f"""WITH RECURSIVE {CHAIN_EDGES_SQL}, known AS (SELECT c.src, c.dst FROM chain c JOIN orders o ON o.o_orderkey = c.dst),
      fwd(seed, node, dist) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT w.seed, c.dst, w.dist + 1 FROM fwd w JOIN known c ON c.src = w.node WHERE w.dist < 60),
      bwd(seed, node, dist) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT w.seed, c.src, w.dist + 2 FROM bwd w JOIN known c ON c.dst = w.node WHERE w.dist < 120),
      best AS (SELECT node, seed, dist, row_number() OVER (PARTITION BY node ORDER BY dist, seed) AS r FROM (SELECT * FROM fwd UNION ALL SELECT * FROM bwd))
      SELECT CAST(o_orderkey AS VARCHAR) AS path, seed AS entrypoint, CAST(dist AS INTEGER) AS dist FROM orders LEFT JOIN best ON best.node = o_orderkey AND best.r = 1""",
    "text_keys": r"""SELECT doc_id, CAST((octet_length(encode(text)) + 3) // 4 AS BIGINT) AS tokens,
      sha256('d/' || CAST(doc_id AS VARCHAR) || chr(0) || text) AS content_key, regexp_replace(lower(trim(substr(text, 1, 40))), '\s+', ' ', 'g') AS name FROM documents""",
}
