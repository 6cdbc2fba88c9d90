"""Merkle fixity audit of WARC files, with DataFrame functions only.

``write`` puts pages into WARC/1.1 files, gzipped text files of records that end with two
line breaks, one folder per replica and file; a file's first record, ``warcinfo``, lists
the place and length of the others.  A file holds ``file_records`` consecutive page_ids;
ranges that hold far more records or bytes, as those of null or much repeated page_ids
may, are split into volumes.  ``leaves`` reads the stored bytes back by offset range and
hashes them.

Two trees are kept for each file, both stored level by level.  The tree of records has a
leaf for each slot that a page_id falls in, so a record that is lost or longer moves no
other; the tree of the layout hashes the ordered offset ranges.  ``audit`` compares the
roots of the replicas and descends only into nodes that differ.  In the slots reached,
records of equal content are matched first; what is left is paired by page_id, so
bit rot, longer, shorter, missing and extra records are each told exactly.  ``layout``
tells where the offset ranges of a file first depart, as they also do where records only
change places.

Edge cases: null urls and bodies are written as empty; rows that repeat a page_id are
records one after another, by url and hash; null page_ids have files of their own; ties
are records of equal bytes, which are matched by their number; records may be of any
length up to 2 GiB; columns other than page_id, url and html are left out, whatever their
names; a record that only one replica holds is reported with nulls for the other; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BREAK = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"  # of the capture, which the pages don't tell
FAN_OUT, LEVELS = 16, 3


def _head(kind: str, name: Column, uri: Column, length: Column, date: str) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:"), name, F.lit(f">\r\nWARC-Date: {date}\r\n"), uri, F.lit("Content-Type: " + ("text/html" if kind == "resource" else "text/plain") + "\r\nContent-Length: "), length.cast("string"), F.lit(BREAK)]
    return F.concat(*lines)


def record(url: Column, body: Column, key: Column, date: str = DATE) -> Column:
    """A WARC resource record without its last two line breaks; line breaks in the url are escaped."""
    bare = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = F.concat(F.lit("page:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.concat(_head("resource", name, F.concat(F.lit("WARC-Target-URI: "), bare, F.lit("\r\n")), F.octet_length(body), date), body)


def plan(pages: DataFrame, *, file_records: int = 1024, file_bytes: int = 64 << 20) -> DataFrame:
    """``pages(page_id, url, html)`` with the file of each, nulls filled, and the hash that orders equal ids and urls."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = pages.select("page_id", text("url"), text("html")).withColumn("range", F.coalesce(F.expr(f"cast(floor(page_id / {file_records}) as bigint)"), F.lit(-1).cast("bigint")))
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))
    # stored, so that its size is known where the planner chooses how to join
    large = common.stored(sizes.where(f"n > {2 * file_records} or bytes > {file_bytes}").selectExpr("range", f"greatest(ceil(n / {file_records}), ceil(bytes / {file_bytes})) as volumes"))
    rows = rows.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256)).join(large, "range", "left")
    volume = F.expr("pmod(cast(conv(substring(sha, 1, 8), 16, 10) as bigint), coalesce(volumes, 1))")
    return rows.select(F.concat(F.lit("r"), F.col("range").cast("string"), F.lit("v"), volume.cast("string")).alias("file"), "page_id", "url", "html", "sha")


def write(planned: DataFrame, folder: str, replicas: dict[str, Column] | None = None, *, date: str = DATE) -> None:
    """Writes each replica of ``planned``; a replica is the column of its bodies, null for a record that it lacks."""
    replicas = replicas or {"mine": F.col("html")}
    bodies = F.array(*(F.struct(F.lit(name).alias("replica"), body.alias("body")) for name, body in replicas.items()))
    each = lambda rows: rows.select("file", "page_id", "url", "sha", F.inline(bodies)).where("body is not null")
    place = W.partitionBy("replica", "file").orderBy("page_id", "url", "sha")
    records = lambda rows: each(rows).select("replica", "file", "page_id", "url", "sha", record(F.col("url"), F.col("body"), F.col("page_id"), date).alias("value"))
    sized = records(planned).select("replica", "file", "page_id", "url", "sha", (F.octet_length("value") + len(BREAK)).cast("long").alias("length"))
    sized = sized.withColumn("ord", F.row_number().over(place) - 1).withColumn("start", F.sum("length").over(place.rowsBetween(W.unboundedPreceding, 0)) - F.col("length"))
    line = F.concat_ws(" ", "start", "length", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    index = sized.groupBy("replica", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))  # a file's records are bounded
    info = F.concat(_head("warcinfo", F.concat(F.lit("file:"), "file"), F.lit(""), F.octet_length("text"), date), "text")
    none = lambda t: F.lit(None).cast(t)
    rows = planned.select("file", F.lit(1).alias("part"), none("string").alias("replica"), "page_id", "url", "sha", "html", none("string").alias("info"))
    rows = rows.unionByName(index.select("file", F.lit(0).alias("part"), "replica", none("long").alias("page_id"), none("string").alias("url"), none("string").alias("sha"), none("string").alias("html"), info.alias("info")))
    # one exchange for all replicas: they part after it
    rows = rows.repartition("file").select("file", "part", "page_id", "url", "sha", "info", F.inline(F.when(F.col("part") == 1, bodies).otherwise(F.array(F.struct("replica", F.col("info").alias("body"))))))
    rows = rows.where("body is not null").sortWithinPartitions("replica", "file", "part", "page_id", "url", "sha")
    value = F.when(F.col("part") == 0, F.col("body")).otherwise(record(F.col("url"), F.col("body"), F.col("page_id"), date))
    rows.select("replica", "file", value.alias("value")).write.partitionBy("replica", "file").option("lineSep", BREAK).option("compression", "gzip").text(folder)


def _each_record(spark: SparkSession, folder: str, what) -> DataFrame:
    """(replica, file, ...) with the fields of ``what(bytes, entry)``, a struct, for the stored bytes of each record and its (ord, start, length, page_id)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    schema = "value string, replica string, file string"
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not any(s.isDirectory() for s in fs.listStatus(path)):  # an archive without records
        whole = spark.createDataFrame([], schema)
    else:
        whole = spark.read.schema(schema).text(folder, wholetext=True)
    n = F.regexp_extract("value", r"\r\nContent-Length: (\d+)\r\n\r\n", 1).try_cast("int")
    head = F.instr("value", BREAK) + len(BREAK) - 1
    info = whole.select("replica", "file", "value", head.alias("head"), n.alias("n"))  # the first record is ASCII
    entry = lambda x, i: F.struct(i.alias("ord"), F.get(x, F.lit(0)).try_cast("long").alias("start"), F.get(x, F.lit(1)).try_cast("int").alias("length"), F.get(x, F.lit(2)).try_cast("long").alias("page_id"))
    lines = F.expr("substring(value, head + 1, n)")
    entries = F.transform(F.split(lines, "\n"), lambda x, i: entry(F.split(x, " "), i))
    base = F.col("head") + F.col("n") + len(BREAK)
    # the array around the bytes lets all records share one copy of them
    cut = lambda b: F.transform("entries", lambda e: what(F.substring(b, (F.col("base") + e["start"] + 1).cast("int"), e["length"]), e))
    listed = info.select("replica", "file", "value", base.alias("base"), entries.alias("entries"))
    return listed.select("replica", "file", F.explode(F.transform(F.array(F.col("value").cast("binary")), cut)[0]).alias("r")).select("replica", "file", "r.*")


def leaves(spark: SparkSession, folder: str) -> DataFrame:
    """(replica, file, ord, page_id, start, length, sha) of every record, its bytes read back and hashed."""
    return _each_record(spark, folder, lambda b, e: F.struct(e["ord"].alias("ord"), e["page_id"].alias("page_id"), e["start"].alias("start"), e["length"].cast("long").alias("length"), F.sha2(b, 256).alias("sha")))


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """(replica, file, page_id, url, date, html) of every record, from its stored bytes alone."""

    def fields(b, e):
        text = b.cast("string")
        n = F.regexp_extract(text, r"\r\nContent-Length: (\d+)\r\n\r\n", 1).try_cast("int")
        group = lambda pattern: F.regexp_extract(text, pattern, 1)
        body = F.substring(b, e["length"] - len(BREAK) - n + 1, n).cast("string")
        return F.struct(group("<urn:page:([^>]*)>").try_cast("long").alias("page_id"), group("\r\nWARC-Target-URI: ([^\r]*)\r\n").alias("url"), group("\r\nWARC-Date: ([^\r]*)\r\n").alias("date"), body.alias("html"))

    return _each_record(spark, folder, fields)


def _up(nodes: DataFrame) -> DataFrame:
    """The parents of ``nodes(replica, file, idx, hash)``: the hash of at most ``FAN_OUT`` children with their numbers."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda c: F.concat_ws(":", c["idx"].cast("string"), c["hash"]))
    return nodes.groupBy("replica", "file", F.expr(f"cast(div(idx, {FAN_OUT}) as int)").alias("up")).agg(F.sha2(F.array_join(children, ",").cast("binary"), 256).alias("hash")).withColumnRenamed("up", "idx")


def tree(nodes: DataFrame) -> list[DataFrame]:
    """The levels over ``nodes(replica, file, idx, hash)``, each stored once; the last are the roots."""
    levels = [common.stored(nodes)]
    for _ in range(LEVELS):
        levels.append(common.stored(_up(levels[-1])))
    return levels


def _differing(nodes: DataFrame, mine: str, other: str) -> DataFrame:
    """(file, idx) of the nodes in which the replicas differ."""
    of = lambda name: F.max(F.when(F.col("replica") == name, F.col("hash")))
    return nodes.groupBy("file", "idx").agg(of(mine).alias("a"), of(other).alias("b")).where("not (a <=> b)").select("file", "idx")


def descend(levels: list[DataFrame], mine: str, other: str, *, first: bool = False) -> DataFrame:
    """(file, idx) of the lowest nodes that differ, by way of nodes that differ only; ``first``: only the first of each file."""
    differ = None
    for nodes in reversed(levels):
        if differ is not None:
            nodes = nodes.withColumn("up", F.expr(f"cast(div(idx, {FAN_OUT}) as int)")).join(differ.withColumnRenamed("idx", "up"), ["file", "up"], "left_semi")
        differ = _differing(nodes, mine, other)
        if first:
            differ = differ.groupBy("file").agg(F.min("idx").alias("idx"))
        differ = common.checkpoint(differ)
    return differ


SIDE = ["page_id", "start", "length", "sha"]
PAIR = ("mine.start", "mine.length", "other.start as found_start", "other.length as found_length", "mine.sha as expected", "other.sha as found")


def _slot() -> Column:
    return F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(FAN_OUT**LEVELS)).cast("int")


def audit(found: DataFrame, mine: str = "mine", other: str = "other") -> DataFrame:
    """(file, page_id, start, length, found_start, found_length, expected, found) of every record of ``leaves`` in which two replicas differ."""
    line = F.concat_ws(":", "sha", "length")
    levels = tree(found.groupBy("replica", "file", _slot().alias("idx")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ",").cast("binary"), 256).alias("hash")))
    differ = descend(levels, mine, other)
    rows = found.withColumn("idx", _slot()).join(differ, ["file", "idx"], "left_semi")
    copy = F.row_number().over(W.partitionBy("replica", "file", "page_id", "sha").orderBy("start")).alias("copy")
    side = lambda rows, name, *keys: rows.where(F.col("replica") == name).select("file", *keys, F.struct(*SIDE).alias("mine" if name == mine else "other"))
    counted = rows.select("*", copy)
    key = F.struct("page_id").alias("key")  # equal also where it is null
    whole = side(counted, mine, key, F.col("sha").alias("s"), "copy").join(side(counted, other, key, F.col("sha").alias("s"), "copy"), ["file", "key", "s", "copy"], "full")
    left = whole.where("mine is null or other is null").select("file", "key", F.when(F.col("mine").isNull(), other).otherwise(F.lit(mine)).alias("replica"), F.coalesce("mine", "other").alias("row"))
    left = left.select("file", "key", "replica", "row.*", F.row_number().over(W.partitionBy("file", "key", "replica").orderBy("row.start")).alias("nth"))
    out = side(left, mine, "key", "nth").join(side(left, other, "key", "nth"), ["file", "key", "nth"], "full")
    return out.selectExpr("file", "key.page_id", *PAIR)


def layout(found: DataFrame, mine: str = "mine", other: str = "other") -> DataFrame:
    """As ``audit``, for each file whose ordered offset ranges differ: the first place where they do, with what either replica has there."""
    line = F.concat_ws(":", "start", "length", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    ranges = found.groupBy("replica", "file", F.expr(f"cast(div(ord, {FAN_OUT}) as int)").alias("idx")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), ",").cast("binary"), 256).alias("hash"))
    differ = descend(tree(ranges), mine, other, first=True)
    rows = found.withColumn("idx", F.expr(f"cast(div(ord, {FAN_OUT}) as int)")).join(differ, ["file", "idx"], "left_semi")
    of = lambda name: F.max(F.when(F.col("replica") == name, F.struct(*SIDE)))
    places = rows.groupBy("file", "ord").agg(of(mine).alias("mine"), of(other).alias("other"))
    same = "mine.page_id <=> other.page_id and mine.start <=> other.start and mine.length <=> other.length and mine is not null and other is not null"
    first = places.where(f"not ({same})").groupBy("file").agg(F.min_by(F.struct("mine", "other"), "ord").alias("x")).select("file", "x.mine", "x.other")
    return first.selectExpr("file", "coalesce(mine.page_id, other.page_id) as page_id", *PAIR)


def damage() -> dict[str, Column]:
    """Replicas for tests: records of changed, longer and shorter bodies and lost ones in the second, some lost in the first."""
    rest = F.expr("substring(html, 2)")
    kind = F.col("page_id") % 37
    changed = F.when((kind == 13) & (F.length("html") > 0), F.concat(F.lit("#"), rest)).when(kind == 21, F.concat(F.lit("!!"), "html")).when((kind == 5) & (F.length("html") > 0), rest).otherwise(F.col("html"))
    lost = lambda at, body: F.when(F.coalesce(F.col("page_id") % 97 == at, F.lit(False)), F.lit(None)).otherwise(body)
    return {"mine": lost(51, F.col("html")), "other": lost(50, changed)}


def op2_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    folder = f"{common.folder(planned)}/{uuid.uuid4().hex}.warc"
    write(planned, folder, damage())
    found = common.stored(leaves(spark, folder))
    return audit(found).withColumn("kind", F.lit("record")).unionByName(layout(found).withColumn("kind", F.lit("layout")))


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS hsha,
    coalesce(CAST(floor(page_id / 1024) AS BIGINT), -1) AS range
  FROM pages
), z AS (
  SELECT range, count(*) AS n, sum(strlen(html)) AS bytes FROM p GROUP BY range
), f AS (
  SELECT p.*, 'r' || range || 'v' || CAST(CAST('0x' || substr(hsha, 1, 8) AS BIGINT) % (CASE WHEN n > 2048 OR bytes > 67108864 THEN greatest(CAST(ceil(n / 1024) AS BIGINT), CAST(ceil(bytes / 67108864) AS BIGINT)) ELSE 1 END) AS VARCHAR) AS file
  FROM p JOIN z USING (range)
), r AS (
  SELECT 0 AS side, file, page_id, url, hsha, html AS body FROM f WHERE page_id IS NULL OR page_id % 97 <> 51
  UNION ALL
  SELECT 1, file, page_id, url, hsha,
    CASE WHEN page_id % 37 = 13 AND length(html) > 0 THEN '#' || substr(html, 2) WHEN page_id % 37 = 21 THEN '!!' || html WHEN page_id % 37 = 5 AND length(html) > 0 THEN substr(html, 2) ELSE html END
  FROM f WHERE page_id IS NULL OR page_id % 97 <> 50
), t AS (
  SELECT *, replace(
      'WARC/1.1~WARC-Type: resource~WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>~WARC-Date: 2024-01-01T00:00:00Z~WARC-Target-URI: ', '~', chr(13) || chr(10))
      || replace(replace(url, chr(13), '%0D'), chr(10), '%0A')
      || replace('~Content-Type: text/html~Content-Length: ' || strlen(body) || '~~', '~', chr(13) || chr(10)) || body || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM r
), l AS (
  SELECT side, file, page_id, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS sha,
    row_number() OVER w AS ord, CAST(sum(strlen(rec)) OVER w - strlen(rec) AS BIGINT) AS start
  FROM t WINDOW w AS (PARTITION BY side, file ORDER BY page_id NULLS FIRST, url, hsha ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), c AS (
  SELECT *, row_number() OVER (PARTITION BY side, file, page_id, sha ORDER BY start) AS copy FROM l
), u AS (
  SELECT * FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.side <> x.side AND y.file = x.file AND y.page_id IS NOT DISTINCT FROM x.page_id AND y.sha = x.sha AND y.copy = x.copy)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY side, file, page_id ORDER BY start) AS nth FROM u
), e AS (
  SELECT 'record' AS kind, coalesce(a.file, b.file) AS file, coalesce(a.page_id, b.page_id) AS page_id, a.start, a.length, b.start AS found_start, b.length AS found_length, a.sha AS expected, b.sha AS found
  FROM (SELECT * FROM n WHERE side = 0) a FULL JOIN (SELECT * FROM n WHERE side = 1) b ON a.file = b.file AND a.page_id IS NOT DISTINCT FROM b.page_id AND a.nth = b.nth
), m AS (
  SELECT 'layout' AS kind, coalesce(a.file, b.file) AS file, coalesce(a.page_id, b.page_id) AS page_id, a.start, a.length, b.start AS found_start, b.length AS found_length, a.sha AS expected, b.sha AS found,
    row_number() OVER (PARTITION BY coalesce(a.file, b.file) ORDER BY coalesce(a.ord, b.ord)) AS nth
  FROM (SELECT * FROM l WHERE side = 0) a FULL JOIN (SELECT * FROM l WHERE side = 1) b ON a.file = b.file AND a.ord = b.ord
  WHERE a.page_id IS DISTINCT FROM b.page_id OR a.start IS DISTINCT FROM b.start OR a.length IS DISTINCT FROM b.length
)
SELECT * FROM e
UNION ALL
SELECT kind, file, page_id, start, length, found_start, found_length, expected, found FROM m WHERE nth = 1
"""
