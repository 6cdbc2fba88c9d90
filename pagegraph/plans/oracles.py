"""The queries in DuckDB SQL, over one chain of common table expressions."""

from __future__ import annotations

from ..sources.tables import ROWS

CHAIN = "WITH RECURSIVE " + ROWS.strip() + r""",
cw AS (SELECT row_number() OVER (ORDER BY kind, k) - 1 AS page_no, ns, title, text FROM raw),
pages_in AS (SELECT row_number() OVER (ORDER BY page_no) - 1 AS id, title, text FROM cw WHERE ns = 0),
parsed AS (
  SELECT id, title, text, regexp_matches(text, '(?i)^\s*#REDIRECT\s*\[\[(.*?)\]\]') AS is_redirect,
    CASE WHEN regexp_matches(text, '(?i)^\s*#REDIRECT\s*\[\[(.*?)\]\]') THEN regexp_extract(text, '(?i)^\s*#REDIRECT\s*\[\[(.*?)\]\]', 1) END AS target
  FROM pages_in
),
plink AS (
  SELECT DISTINCT id, upper(substr(l, 1, 1)) || substr(l, 2) AS link
  FROM (SELECT id, split_part(unnest(regexp_extract_all(text, '\[\[(.*?)\]\]', 1)), '|', 1) AS l FROM parsed WHERE NOT is_redirect)
  WHERE NOT contains(l, ':')
),
latest AS (SELECT id, title, is_redirect, target FROM parsed QUALIFY row_number() OVER (PARTITION BY title ORDER BY id DESC) = 1),
universe AS (SELECT title FROM parsed UNION SELECT link FROM plink),
hop AS (
  SELECT p.id, CASE WHEN t.is_redirect THEN t.id END AS next, CASE WHEN u.title IS NULL THEN 'fail' WHEN t.id IS NULL OR NOT t.is_redirect THEN 'ok' END AS ended
  FROM latest p LEFT JOIN universe u ON p.target = u.title LEFT JOIN latest t ON p.target = t.title WHERE p.is_redirect
),
walk AS (SELECT id, id AS cur FROM hop UNION SELECT w.id, h.next FROM walk w JOIN hop h ON w.cur = h.id WHERE h.ended IS NULL),
gone AS (SELECT w.id FROM walk w JOIN hop h ON w.cur = h.id GROUP BY w.id HAVING count(*) FILTER (WHERE h.ended = 'ok') = 0 AND min(h.id) = w.id),
hashed AS (
  SELECT id, title, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash
  FROM (SELECT id, title, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(title, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM latest WHERE is_redirect)
),
live AS (SELECT * FROM latest WHERE id NOT IN (SELECT id FROM gone)),
edges AS (
  SELECT l.id AS src, t.id AS dst FROM plink l JOIN live a ON a.id = l.id JOIN live t ON t.title = l.link
  UNION SELECT r.id, t.id FROM live r JOIN live t ON t.title = r.target WHERE r.is_redirect
),
degree_out AS (SELECT n.id, count(e.src) AS degree FROM live n LEFT JOIN edges e ON e.src = n.id GROUP BY n.id)
"""

STATS = """
SELECT (SELECT count(*) FROM {t} WHERE NOT is_redirect) AS articles, (SELECT count(*) FROM {t} WHERE is_redirect) AS redirects,
  (SELECT count(*) FROM plink l JOIN {t} a ON a.id = l.id WHERE l.link IN (SELECT title FROM {t})) AS links,
  (SELECT count(*) FROM universe WHERE title NOT IN (SELECT title FROM {t}))
  + (SELECT count(*) FROM plink l JOIN {t} a ON a.id = l.id WHERE l.link NOT IN (SELECT title FROM {t})) AS null_links
"""


def search(pairs: str) -> str:
    """More expressions: ``asked`` from ``pairs``, distances to each end, and the routes by smallest ids."""
    return f""",
asked AS ({pairs}),
ends AS (SELECT a.query_id, s.id AS start_id, e.id AS end_id FROM asked a LEFT JOIN live s ON s.title = a.start LEFT JOIN live e ON e.title = a.end_title),
away(query_id, node, d) USING KEY (query_id, node) AS (
  SELECT query_id, end_id, 0 FROM ends WHERE start_id IS NOT NULL AND end_id IS NOT NULL
  UNION
  SELECT b.query_id, e.src, min(b.d) + 1 FROM away b JOIN edges e ON e.dst = b.node
  WHERE (b.query_id, e.src) NOT IN (SELECT (query_id, node) FROM recurring.away) GROUP BY b.query_id, e.src
),
steps AS (
  SELECT a.query_id, 0 AS step, a.node AS id, a.d FROM away a JOIN ends n ON n.query_id = a.query_id AND n.start_id = a.node
  UNION ALL
  SELECT s.query_id, s.step + 1, min(a.node), s.d - 1 FROM steps s JOIN edges e ON e.src = s.id JOIN away a ON a.query_id = s.query_id AND a.node = e.dst AND a.d = s.d - 1
  WHERE s.d > 0 GROUP BY s.query_id, s.step, s.d
)
"""


def pairs(*given: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS query_id, '{a}' AS start, '{b}' AS end_title" for i, (a, b) in enumerate(given))


def route(start: str, end: str) -> str:
    return CHAIN + search(pairs((start, end))) + "SELECT s.step, s.id, n.title FROM steps s JOIN live n ON n.id = s.id"


PAGES = "SELECT n.id, n.title, n.is_redirect, CAST(count(e.dst) AS INTEGER) AS n_links, coalesce(string_agg(CAST(e.dst AS VARCHAR), ',' ORDER BY e.dst), '') AS links FROM live n LEFT JOIN edges e ON e.src = n.id GROUP BY n.id, n.title, n.is_redirect"
NATIONS = "SELECT CAST(a.n_nationkey AS BIGINT) AS query_id, a.n_name AS start, b.n_name AS end_title FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 3) % 25"

_over_chain = {
    "dump_main_pages": "SELECT id, title FROM pages_in",
    "wikitext_links": "SELECT id, link FROM plink",
    "wikitext_redirects": "SELECT id, title, target FROM parsed WHERE is_redirect",
    "title_universe": "SELECT title FROM universe",
    "red_links": "SELECT title FROM universe WHERE title NOT IN (SELECT title FROM latest)",
    "redirect_cleanup": "SELECT id, title FROM latest WHERE id IN (SELECT id FROM gone)",
    "packed_pages": PAGES,
    "stats_before_cleanup": STATS.format(t="latest"),
    "stats_after_cleanup": STATS.format(t="live"),
    "avg_links": "SELECT round(links / articles, 6) AS avg_links FROM (" + STATS.format(t="live") + ")",
    "forward_edges": "SELECT src, dst FROM edges",
    "reverse_edges": "SELECT dst AS src, src AS dst FROM edges",
    "out_neighbors": "SELECT n.id, e.dst AS neighbor FROM live n JOIN edges e ON e.src = n.id",
    "in_neighbors": "SELECT n.id, e.src AS neighbor FROM live n JOIN edges e ON e.dst = n.id",
    "out_degree": "SELECT id, degree FROM degree_out",
    "in_degree": "SELECT n.id, count(e.dst) AS degree FROM live n LEFT JOIN edges e ON e.dst = n.id GROUP BY n.id",
    "csr_offsets": "SELECT id, degree, CAST(sum(degree) OVER (ORDER BY id) - degree AS BIGINT) AS start FROM degree_out",
    "id_rank": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM live",
    "graph_counts": "SELECT (SELECT count(*) FROM live) AS nodes, (SELECT count(*) FROM edges) AS edges",
    "dangling_edges": """SELECT src, dst FROM (
        SELECT l.id AS src, t.id AS dst FROM plink l JOIN latest a ON a.id = l.id JOIN latest t ON t.title = l.link
        UNION SELECT r.id, t.id FROM latest r JOIN latest t ON t.title = r.target WHERE r.is_redirect)
        WHERE src IN (SELECT id FROM gone) OR dst IN (SELECT id FROM gone)""",
    "title_lookup": "SELECT id, title, is_redirect FROM live WHERE title = 'NATION_15'",
    "has_title": "SELECT t.title, t.title IN (SELECT title FROM live) AS found FROM (VALUES ('AFRICA'), ('africa'), ('Nowhere 0'), ('Loop 1')) t(title)",
    "id_to_title": "SELECT i.id, n.title FROM (SELECT DISTINCT dst AS id FROM edges UNION ALL SELECT -1) i LEFT JOIN live n ON n.id = i.id",
    "is_redirect": "SELECT id, is_redirect FROM live",
    "title_prefix_top10": "SELECT title FROM live WHERE starts_with(title, 'Part 1') ORDER BY title LIMIT 10",
    "title_prefix_empty": "SELECT title FROM live ORDER BY title LIMIT 10",
    "sort_by_title": "SELECT title, row_number() OVER (ORDER BY title) - 1 AS rank FROM live",
    "sort_by_id": "SELECT id, title, row_number() OVER (ORDER BY id) - 1 AS rank FROM live",
    "page_string": "SELECT id, '\"' || title || '\" (#' || id || '), ' || n_links || ' links' AS text FROM (" + PAGES + ")",
    "record_size": "SELECT id, CAST(16 + 4 * n_links + strlen(title) AS BIGINT) AS bytes FROM (" + PAGES + ")",
    "title_bytes": "SELECT id, CAST(strlen(title) AS INTEGER) AS bytes FROM live",
    **dict.fromkeys(("storage_roundtrip", "buffer_roundtrip", "segment_roundtrip"), "SELECT id, title, is_redirect, md5(links) AS links_md5 FROM (" + PAGES + ")"),
    "xml_roundtrip": "SELECT page_no, ns, title, CAST(length(text) AS INTEGER) AS chars, true AS same FROM cw",
    "redirect_cleanup_by_hash": """SELECT id, title FROM latest WHERE id IN (
        SELECT w.id FROM walk w JOIN hop h ON w.cur = h.id JOIN hashed k ON k.id = h.id JOIN hashed m ON m.id = w.id
        GROUP BY w.id, m.hash, m.title HAVING count(*) FILTER (WHERE h.ended = 'ok') = 0 AND min((k.hash, k.title)) = (m.hash, m.title))""",
}

ORACLES: dict[str, str] = {name: CHAIN + sql for name, sql in _over_chain.items()} | {
    "wikitext_capitalize": "SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title FROM part",
    "page_upsert_last_wins": "SELECT max(page_id) AS id, title FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages) GROUP BY title",
    "bfs_levels": CHAIN
    + """, reach(node, d) USING KEY (node) AS (
  SELECT id, 0 FROM live WHERE title = 'Customer#000000000'
  UNION
  SELECT e.dst, min(r.d) + 1 FROM reach r JOIN edges e ON e.src = r.node WHERE e.dst NOT IN (SELECT node FROM recurring.reach) GROUP BY e.dst
) SELECT node AS id, d AS depth FROM reach""",
    "route": route("AFRICA", "Part 7"),
    "route_redirects": route("Merchant 3", "Supplier#000000003"),
    "route_same_node": route("ASIA", "ASIA"),
    "route_unreachable": route("Customer#000000000", "NATION_4"),
    "route_missing_title": CHAIN
    + ", asked AS ("
    + pairs(("Loop 0", "AFRICA"), ("AFRICA", "Nobody"), ("Nobody", "Loop 0"), ("AFRICA", "ASIA"))
    + """) SELECT CAST(query_id AS BIGINT) AS query_id, CASE WHEN s.id IS NULL AND e.id IS NULL THEN 'missing_both' WHEN s.id IS NULL THEN 'missing_start' WHEN e.id IS NULL THEN 'missing_end' ELSE 'ok' END AS status
  FROM asked a LEFT JOIN live s ON s.title = a.start LEFT JOIN live e ON e.title = a.end_title""",
    "route_lengths_batch": CHAIN
    + search(NATIONS)
    + """SELECT n.query_id, CASE WHEN n.start_id IS NULL AND n.end_id IS NULL THEN 'missing_both' WHEN n.start_id IS NULL THEN 'missing_start' WHEN n.end_id IS NULL THEN 'missing_end' WHEN a.d IS NULL THEN 'unreachable' ELSE 'ok' END AS status, coalesce(a.d, -1) AS hops
  FROM ends n LEFT JOIN away a ON a.query_id = n.query_id AND a.node = n.start_id""",
    "route_string": CHAIN
    + search(pairs(("AFRICA", "Part 7"), ("Loop 1", "Loop 3"), ("Customer#000000000", "NATION_4")))
    + """SELECT CAST(n.query_id AS BIGINT) AS query_id, coalesce(string_agg('"' || t.title || '"', ' -> ' ORDER BY s.step), 'No route found') AS text
  FROM ends n LEFT JOIN steps s ON s.query_id = n.query_id LEFT JOIN live t ON t.id = s.id GROUP BY n.query_id""",
    "benchmark_stats": "SELECT count(value) AS n, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS stddev, round(sum(value), 4) AS sum FROM events",
    "index_ranges": """WITH s AS (SELECT DISTINCT (o_orderkey // 100) * 61600 + 600 AS start FROM orders UNION SELECT 0)
  SELECT start, CAST(coalesce(lead(start) OVER (ORDER BY start), 1099511627776) AS BIGINT) AS stop FROM s""",
    "bz2_streams": "SELECT CAST(c_custkey // 1000 AS VARCHAR) AS path, row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) AS stream, c_name AS text FROM customer",
}
