"""DuckDB SQL for the queries of `more_queries`."""

from __future__ import annotations

from ..functions import paths as pt
from ..functions.rules import sql
from ..operators.dataflow import FRAMEWORKS, NEXT_ENDS
from . import oracles as o
from .adapters import CALLS_SQL, GROUP_FILES_SQL, PATHS_SQL, picked_sql
from .more_queries import KINDS, SOURCES

_ONE = f"{GROUP_FILES_SQL}, one AS (SELECT path, min(group_no) AS group_no FROM group_files GROUP BY path)"
_FRAMEWORKS = ", ".join(f"('{p}', '{n}')" for p, n in FRAMEWORKS.items())


def _tokens(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, t FROM (SELECT {key}, regexp_replace(unnest(regexp_extract_all({o.BARE_STEM} || ' ' || lower(array_to_string(list_slice(string_split(path, '/'),
      greatest(len(string_split(path, '/')) - 3, 1), len(string_split(path, '/')) - 1), ' ')), '[a-z0-9]+')), '^[0-9]+', '') AS t FROM {table}) WHERE strlen(t) >= 3 AND t NOT IN {o.listed(pt.GENERIC_TOPICS)}"""


_NAME = "regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '')"
_UNMARKED = f"replace(replace(replace(replace({_NAME}, '.test', ''), '.spec', ''), '_test', ''), 'test_', '')"
_JOBS = f"""jobs AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, {picked_sql(KINDS, 'event_id + user_id')} AS type, ts FROM events)"""

_STATES = f"""WITH {_JOBS} SELECT job_id, count(*) AS events, max(seq) AS last_seq, min(seq) FILTER (WHERE type IN ('JobCompleted', 'JobFailed')) AS ended_at,
      max(type) FILTER (WHERE type IN ('JobCompleted', 'JobFailed')) AS outcome FROM jobs GROUP BY job_id"""

ORACLES = {
    "framework_detection": f"""WITH {CALLS_SQL}, {PATHS_SQL}, src AS (SELECT DISTINCT {picked_sql(SOURCES, 'pos')} AS s FROM calls), f(pattern, framework) AS (VALUES {_FRAMEWORKS})
      SELECT DISTINCT framework FROM src JOIN f ON s = pattern OR (starts_with(s, pattern) AND substr(s, strlen(pattern) + 1, 1) IN ('/', '.', ':', '\\'))
      UNION SELECT 'Next.js' FROM paths WHERE (contains(path, 'pages/') OR contains(path, 'app/')) AND ({' OR '.join(f"ends_with(path, '{e}')" for e in NEXT_ENDS)})""",
    "topic_affinity": f"""WITH {PATHS_SQL}, {_ONE}, f AS (SELECT DISTINCT path FROM paths), ft AS ({_tokens('f', 'path')}), g AS (SELECT group_no, path AS path FROM one), gt AS ({_tokens('g', 'group_no, path')}),
      shared AS (SELECT ft.path, gt.group_no, gt.path AS other, count(*) AS n FROM ft JOIN gt ON ft.t = gt.t GROUP BY 1, 2, 3),
      best AS (SELECT path, group_no, max(n) AS score FROM shared GROUP BY 1, 2),
      top AS (SELECT path, max(score) AS score FROM best GROUP BY path)
      SELECT b.path, min(b.group_no) AS group_no, b.score FROM best b JOIN top t ON b.path = t.path AND b.score = t.score GROUP BY b.path, b.score HAVING b.score >= 2 OR count(*) = 1""",
    "test_subject_groups": f"""WITH {_ONE}, k AS (SELECT path, group_no, {o.TEST_FILE} AS test, {o.CONTEXT_STEM} AS stem, {_NAME} AS plain, {_UNMARKED} AS unmarked FROM one),
      s AS (SELECT stem, arg_max(group_no, path) AS g FROM k WHERE NOT test GROUP BY stem), b AS (SELECT plain, arg_max(group_no, path) AS g FROM k WHERE NOT test GROUP BY plain)
      SELECT k.path, CASE WHEN test THEN coalesce(s.g, b.g, group_no) ELSE group_no END AS group_no FROM k LEFT JOIN s ON s.stem = k.stem LEFT JOIN b ON b.plain = k.unmarked""",
    "exact_directory_groups": f"""WITH {PATHS_SQL}, {GROUP_FILES_SQL}, f AS (SELECT DISTINCT path FROM paths), g AS (SELECT DISTINCT group_no, path FROM group_files),
      c AS (SELECT regexp_replace(path, '/[^/]*$', '') AS k, group_no, count(*) AS n FROM g GROUP BY 1, 2),
      r AS (SELECT k, group_no, rank() OVER (PARTITION BY k ORDER BY n DESC) AS r FROM c), u AS (SELECT k, min(group_no) AS group_no FROM r WHERE r = 1 GROUP BY k HAVING count(*) = 1)
      SELECT path, group_no FROM f JOIN u ON regexp_replace(path, '/[^/]*$', '') = u.k""",
    "infrastructure_groups": f"""WITH {PATHS_SQL}, f AS (SELECT DISTINCT path, {o.CATEGORY} AS category FROM paths), rest AS (SELECT path, regexp_replace(path, '[^/]*$', '') AS dir FROM f WHERE category = 'Unclassified'),
      hub AS (SELECT dir FROM rest GROUP BY dir HAVING bool_or(path = dir || 'models.py') AND count(*) > 1), loose AS (SELECT * FROM rest WHERE dir NOT IN (SELECT dir FROM hub)),
      n AS (SELECT dir, count(*) AS n FROM loose GROUP BY dir)
      SELECT {o.mapped('category', pt.CATEGORY_LABELS)} AS name, category, string_agg(path, ',' ORDER BY path) AS files FROM f WHERE category <> 'Unclassified' GROUP BY category
      UNION ALL SELECT dir, 'DirectoryGroup', string_agg(path, ',' ORDER BY path) FROM rest WHERE dir IN (SELECT dir FROM hub) GROUP BY dir
      UNION ALL SELECT dir, 'DirectoryGroup', string_agg(path, ',' ORDER BY path) FROM loose WHERE dir IN (SELECT dir FROM n WHERE n >= 2) GROUP BY dir
      UNION ALL SELECT 'Unclassified', 'Unclassified', string_agg(path, ',' ORDER BY path) FROM loose WHERE dir IN (SELECT dir FROM n WHERE n < 2) HAVING count(*) > 0""",
    "threshold_scores": """WITH x AS (SELECT o_orderkey, o_custkey, CAST(o_custkey % 100 AS DOUBLE) / 100 AS a, CAST(o_orderkey % 90 AS DOUBLE) / 100 AS l FROM orders)
      SELECT o_orderkey, round(CASE WHEN a <= l THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - (a - l) / (1.0 - l))) END, 9) AS score,
        CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE round(CAST(o_custkey AS DOUBLE) / CAST(o_orderkey % 7 AS DOUBLE), 9) END AS ratio FROM x""",
    "job_states": _STATES,
    "streamed_job_states": _STATES,
    "job_timeline": f"WITH {_JOBS} SELECT job_id, type AS kind, count(*) AS n FROM jobs GROUP BY job_id, type",
    "job_activity_by_hour": f"WITH {_JOBS} SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_start, type, count(*) AS n FROM jobs GROUP BY 1, 2",
    "exported_comments": """WITH c AS (SELECT 'g' || CAST(conv_id AS VARCHAR) AS group_id, turn, CASE role
        WHEN 'user' THEN 'f' || CAST(turn AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || '-' || CAST(turn + 2 AS VARCHAR) || chr(10) || 'code' || chr(10) || '> ' || text
        WHEN 'assistant' THEN 'f' || CAST(turn AS VARCHAR) || chr(10) || '> ' || text WHEN 'system' THEN '> ' || text END AS line FROM conversations)
      SELECT group_id, sha256(string_agg(line, chr(10) || chr(10) ORDER BY turn)) AS text_sha256 FROM c GROUP BY group_id""",
    "manifest_import": f"""WITH {GROUP_FILES_SQL}, k AS (SELECT *, NOT {o.TEST_FILE} AS known FROM group_files), m AS (
        SELECT group_id AS name, path || '/' || CAST(pos AS VARCHAR) AS p, CASE WHEN known THEN {o.ROLE} ELSE 'Utility' END AS role, CASE WHEN known THEN additions ELSE 0 END AS additions,
          CASE WHEN known THEN deletions ELSE 0 END AS deletions, CASE WHEN known AND {sql('path', pt.RISK['is_auth'])} THEN 0.35 ELSE 0.0 END AS risk FROM k)
      SELECT name, p AS path, role, additions, deletions, round(CAST(sum(risk) OVER (PARTITION BY name) AS DOUBLE) / count(*) OVER (PARTITION BY name), 9) AS group_risk FROM m""",
    "manifest_export": f"""WITH {PATHS_SQL}, {_ONE} SELECT 'Group group_' || CAST(group_no AS VARCHAR) AS name, CAST(length('group_' || CAST(group_no AS VARCHAR)) AS INTEGER) AS review_order, string_agg(path, ',' ORDER BY path) AS files FROM one GROUP BY group_no
      UNION ALL SELECT 'unassigned', NULL, coalesce(string_agg(path, ',' ORDER BY path), '') FROM (SELECT DISTINCT path FROM paths) WHERE path NOT IN (SELECT path FROM one)""",
    "repaired_references": """SELECT CASE WHEN c_custkey % 3 = 2 THEN 'nobody' ELSE CAST(c_nationkey AS VARCHAR) END AS group_id, c_custkey % 3 = 1 AS repaired, c_custkey AS op FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "review_order": """WITH w AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS group_id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey % 50 ELSE CAST(floor(c_acctbal) AS BIGINT) + 2000 END AS wanted FROM customer)
      SELECT group_id, CAST(row_number() OVER (ORDER BY wanted, group_id) AS INTEGER) AS review_order FROM w""",
    "constraint_results": """WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), c AS (SELECT l_orderkey, count(*) AS m, count(DISTINCT s_nationkey) AS d FROM p JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey)
      SELECT l_orderkey AS set_id, CASE WHEN l_orderkey % 2 = 0 THEN 'same' ELSE 'separate' END AS kind, CASE WHEN l_orderkey % 2 = 0 THEN d = 1 ELSE d = m END AS satisfied FROM c""",
    "symbol_bindings": f"""WITH f AS (SELECT DISTINCT 'src/m' || CAST(o_orderkey % 400 AS VARCHAR) || {picked_sql(('.ts', '.py', '/index.ts'), 'o_orderkey')} AS path FROM orders),
      i AS (SELECT path, 'm' || CAST((length(path) * 37 + CAST(regexp_extract(path, '[0-9]+', 0) AS INTEGER)) % 400 AS VARCHAR) AS s FROM f),
      t AS (SELECT path, s, regexp_replace(path, '[^/]*$', '') || s AS target FROM i)
      SELECT t.path, './' || s AS source, coalesce(a.path, b.path, c.path) AS resolved FROM t LEFT JOIN f a ON a.path = target || '.ts' LEFT JOIN f b ON b.path = target || '.py' LEFT JOIN f c ON c.path = target || '/index.ts'""",
    "group_diagrams": """WITH first AS (SELECT l_orderkey, 'src/p' || CAST(l_partkey AS VARCHAR) || '.ts' AS path, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2),
      n AS (SELECT *, chr(CAST(64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY p, path) AS INTEGER)) AS letter FROM first),
      nodes AS (SELECT l_orderkey, string_agg('    ' || letter || '["' || path || '"]', chr(10) ORDER BY letter) AS t FROM n GROUP BY l_orderkey),
      edges AS (SELECT a.l_orderkey, string_agg('    ' || a.letter || ' -->|' || CASE WHEN a.p % 2 = 0 THEN 'calls' ELSE 'new' END || '| ' || b.letter, chr(10) ORDER BY a.p, a.letter || b.letter) AS t FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND b.p = a.p + 1 GROUP BY a.l_orderkey)
      SELECT 'o' || CAST(nodes.l_orderkey AS VARCHAR) AS group_id, 'graph TD' || chr(10) || nodes.t || coalesce(chr(10) || edges.t, '') AS diagram FROM nodes LEFT JOIN edges ON edges.l_orderkey = nodes.l_orderkey""",
    "source_facts": """SELECT 'src/d' || CAST(doc_id AS VARCHAR) || '.py' AS path, CAST(i AS BIGINT) AS pos, CASE i WHEN 0 THEN 'load' ELSE 'save' END AS callee, CAST(4 + i AS BIGINT) AS line, 'f' || CAST(doc_id AS VARCHAR) AS containing_function,
      CASE i WHEN 0 THEN 'a' ELSE 'x' END AS arguments FROM documents, (VALUES (0), (1)) v(i)""",
    "renumbered_groups": f"""WITH {PATHS_SQL}, g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS d, min(path) AS first_file FROM paths GROUP BY 1)
      SELECT 'group_' || CAST(row_number() OVER (ORDER BY first_file) AS VARCHAR) AS group_id, split_part(d, '/', -1) || ' (directory)' AS name, first_file FROM g""",
    "repository_scores": """WITH m AS (SELECT s_suppkey AS repo, s_suppkey % 40 AS g, (s_suppkey % 17) / 10 AS dens, (s_suppkey % 11) / 10 AS infra, (s_suppkey % 7) / 6 AS single,
        s_suppkey % 3 <> 0 AS acc, s_suppkey % 4 AS checks, (s_suppkey % 5) / 4 AS golden, s_suppkey % 2 = 0 AS limited FROM supplier),
      p AS (SELECT *, CASE WHEN g <= 20 THEN 1.0 ELSE 20 / g END AS c, CASE WHEN limited THEN CASE WHEN dens <= 0.6 THEN 1.0 ELSE greatest(0, 1 - (dens - 0.6) / 0.4) END END AS d,
        CASE WHEN infra <= 0.5 THEN 1.0 ELSE greatest(0, 1 - (infra - 0.5) / 0.5) END AS i, CASE WHEN single <= 0.4 THEN 1.0 ELSE greatest(0, 1 - (single - 0.4) / 0.6) END AS s,
        CASE WHEN acc THEN 1.0 ELSE 0.0 END AS f FROM m)
      SELECT repo, round(CAST(c AS DOUBLE), 9) AS group_count, round(CAST(d AS DOUBLE), 9) AS group_density, round(CAST(i AS DOUBLE), 9) AS infra_ratio,
        round(CAST(s AS DOUBLE), 9) AS singleton_ratio, CAST(f AS DOUBLE) AS file_accounting,
        round(CAST(CASE WHEN limited AND checks = 0 THEN 0.2 * c + 0.2 * d + 0.2 * i + 0.2 * s + 0.2 * f WHEN limited THEN 0.15 * c + 0.15 * d + 0.1 * i + 0.1 * s + 0.1 * f + 0.4 * golden
          WHEN checks = 0 THEN 0.35 * c + 0.25 * i + 0.2 * s + 0.2 * f ELSE 0.2 * c + 0.15 * i + 0.15 * s + 0.1 * f + 0.4 * golden END AS DOUBLE), 9) AS overall FROM p""",
    "accounting_scores": """SELECT s_suppkey AS repo, CAST(greatest(0, 1 - CASE WHEN s_suppkey % 5 <> s_suppkey % 3 THEN 0.5 ELSE 0 END - CASE WHEN s_suppkey % 2 = 1 THEN 0.5 ELSE 0 END
      - CASE WHEN s_suppkey % 12 < 2 OR s_suppkey % 12 > 8 THEN 0.25 ELSE 0 END) AS DOUBLE) AS score FROM supplier""",
    "text_names": r"""SELECT doc_id, sha256(name) AS name_sha256, length(name) AS name_chars FROM
      (SELECT doc_id, regexp_replace(lower(trim(coalesce(text, ''))), '\s+', ' ', 'g') AS name FROM documents)""",
    "global_order": "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders",
    "expected_coherence": f"""WITH {PATHS_SQL}, {_ONE}, e(eid, piece, must) AS (VALUES (1, 'auth/user.service.ts', true), (1, 'auth/README.md', true), (1, 'docs/index', false),
        (2, 'scripts/build.sh', true), (2, 'nowhere', true), (3, 'Dockerfile', true), (3, 'zz', false)),
      sz AS (SELECT eid, count(*) FILTER (WHERE must) AS nm, count(*) FILTER (WHERE NOT must) AS nn FROM e GROUP BY eid),
      h AS (SELECT DISTINCT eid, group_no, piece, must FROM one JOIN e ON contains(path, piece)),
      f AS (SELECT eid, group_no, count(*) FILTER (WHERE must) AS y, count(*) FILTER (WHERE NOT must) AS n FROM h GROUP BY 1, 2),
      b AS (SELECT f.eid, max(greatest(0.0, y / nm - 0.5 * CASE WHEN nn = 0 THEN 0 ELSE n / nn END)) AS best FROM f JOIN sz ON sz.eid = f.eid GROUP BY f.eid),
      l AS (SELECT eid, count(DISTINCT piece) AS lost FROM paths JOIN e ON contains(path, piece) WHERE must AND {sql('path', pt.ENVIRONMENT)} GROUP BY eid)
      SELECT round(sum(CASE WHEN lost > 0 THEN least(coalesce(best, 0), 1 - lost / nm) ELSE coalesce(best, 0) END * greatest(nm, 1)) / sum(greatest(nm, 1)), 9) AS score
      FROM sz LEFT JOIN b ON b.eid = sz.eid LEFT JOIN l ON l.eid = sz.eid""",
}
