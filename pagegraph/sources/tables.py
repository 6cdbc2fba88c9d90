"""The driver's star-schema tables, and a wiki dump made of them.

``commerce_dump`` is one dump row for each region, nation, supplier, part, customer and
order, with redirects, redirect cycles, red links and a duplicate title among them.  It
gives the ingest operators something to parse at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..lineage import stored
from ..operators.ranking import dense_index

TABLES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")

#: (kind, k, ns, title, text) rows; runs unchanged in Spark SQL and DuckDB.
ROWS = """
nsup AS (SELECT count(*) AS n FROM supplier),
raw AS (
  SELECT 0 AS kind, CAST(r_regionkey AS BIGINT) AS k, 0 AS ns, r_name AS title,
         (string_agg('[[' || n_name || ']]', ' ')) AS text
    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
  UNION ALL SELECT 1, CAST(n_nationkey AS BIGINT), 0, n_name,
         max('[[' || r_name || '|home]]') || coalesce(string_agg('[[s' || substr(s_name, 2) || ']]', ' '), '')
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey
    GROUP BY n_nationkey, n_name
  UNION ALL SELECT 2, s_suppkey, 0, s_name,
         max('[[' || n_name || ']] [[' || s_name || ']] ') || coalesce(string_agg('[[Part ' || l_partkey || ']]', ' '), '')
    FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey
    GROUP BY s_suppkey, s_name
  UNION ALL SELECT 3, p_partkey, 0, 'Part ' || p_partkey, '[[' || p_name || ']] [[Brand x|' || p_brand || ']]' FROM part
  UNION ALL SELECT 4, c_custkey, 0, c_name,
         max('[[Category:' || c_mktsegment || ']] [[Merchant ' || (c_custkey % nsup.n) || ']] [[Loop ' || (c_custkey % 25) || ']] [[Nowhere 0]] ')
         || coalesce('[[Order ' || min(o_orderkey) || ']]', '')
    FROM customer CROSS JOIN nsup LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name
  UNION ALL SELECT 5, o_orderkey, 0, 'Order ' || o_orderkey,
         max(coalesce('[[Order ' || nxt || ']] ', '')) || coalesce(string_agg('[[Part ' || l_partkey || ']]', ' '), '')
    FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) o
    LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
  UNION ALL SELECT 6, s_suppkey, 0, 'Vendor ' || s_suppkey, '#REDIRECT [[' || s_name || ']]' FROM supplier
  UNION ALL SELECT 7, s_suppkey, 0, 'Merchant ' || s_suppkey, '#REDIRECT [[Vendor ' || s_suppkey || ']]' FROM supplier
  UNION ALL SELECT 8, CAST(n_nationkey AS BIGINT), 0, 'Loop ' || n_nationkey,
         '#REDIRECT [[Loop ' || (n_nationkey - n_nationkey % 5 + (n_nationkey + 1) % 5) || ']]' FROM nation
  UNION ALL SELECT 9, CAST(r_regionkey AS BIGINT), 0, 'Ghost ' || r_regionkey, '#REDIRECT [[Nowhere ' || r_regionkey || ']]' FROM region
  UNION ALL SELECT 10, CAST(n_nationkey AS BIGINT), 1, 'Talk:' || n_name, '[[' || n_name || ']]' FROM nation
  UNION ALL SELECT 11, CAST(r_regionkey AS BIGINT), 0, r_name, '[[NATION_4]]' FROM region WHERE r_regionkey = 4
)
"""


def commerce_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_no, ns, title, text) with page numbers in the order of (kind, k)."""
    sql = "WITH " + ROWS.strip() + " SELECT kind * 1099511627776L + k AS place, ns, title, text FROM raw"
    for name in TABLES:
        sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ").replace(f"FROM {name})", f"FROM {{{name}}})").replace(f"FROM {name}\n", f"FROM {{{name}}}\n")
    frames = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    # stored before it is numbered, so that the texts are made once
    return dense_index(stored(spark.sql(sql, **frames)), "place", "page_no").select("page_no", "ns", "title", "text")
