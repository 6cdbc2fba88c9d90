"""Every registered graph query against its DuckDB oracle."""

import duckdb
import pytest

from pagegraph import golden
from pagegraph.operators import ingest
from pagegraph.plans.oracles import ORACLES
from pagegraph.plans.queries import QUERIES
from pagegraph.plans.views import views
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, values.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_queries_without_oracle(spark, sf_dir):
    assert sorted(set(QUERIES) - set(ORACLES)) == ["random_title"]
    title = QUERIES["random_title"](spark, sf_dir).first().title
    assert title in {r.title for r in QUERIES["sort_by_id"](spark, sf_dir).collect()}


def test_golden_lengths(spark, sf_dir):
    assert len(golden.PAIRS) == 50 and sum(n == 0 for *_, n in golden.PAIRS) == 23
    pairs = [("AFRICA", "Part 7", 4), ("AFRICA", "nobody", 0), ("ASIA", "ASIA", 1), ("ASIA", "AFRICA", 9)]
    got = {r.query_id: r for r in golden.check(views(spark, sf_dir).graph, pairs).collect()}
    assert [got[i].ok for i in range(4)] == [True, True, True, False]


def test_hash_rank(spark):
    def hashed(title):
        h = 0
        units = title.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    titles = ["", "a", "Foo redirect", "Ἐπίδαυρος", "🙂x", "polygenelubricants"]
    frame = spark.createDataFrame([(t,) for t in titles], "title string").select("title", ingest.java_hash_rank(F.col("title")).alias("r"))
    assert {r.title: r.r.hash for r in frame.collect()} == {t: hashed(t) for t in titles}


def test_no_text_is_moved(spark, sf_dir):
    for name in ("dump_main_pages", "xml_roundtrip"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            assert not ("Exchange" in line and "text#" in line and "md5" not in line), line


def test_entry(spark):
    import __spark_entry__

    assert [r.title for r in __spark_entry__.entry(spark).orderBy("step").collect()][::3] == ["AFRICA", "Part 7"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
