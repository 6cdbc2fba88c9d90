"""Near-duplicate line removal by a deletion-neighbourhood join, with DataFrame functions only.

Lines are sequences of words; the edit bound is one word put in, left out or replaced
for lines of ``edit_from`` words or more, and none for shorter ones.  A line is dropped
if an earlier one, by (doc_id, line number), is within the bound of both; lines without
words stay.

1. Equal lines come down to one, the earliest, by an aggregate.
2. Lines within the bound share their first or their last half, so lines that share
   neither with another line need no neighbourhood: a pre-filter that loses nothing.
3. The rest emit their deletion neighbourhood as hashed keys: the line itself and, for
   each position, the line without that word.  A key is a sum over the other words'
   hashes with their places, so running sums give all keys of a line.  A line that shares
   just one half with others leaves out words of the other half only.
4. Equal keys meet.  Two lines that lack a word at the same position and are equal
   otherwise differ by that word; a line that equals another without a word lacks it.
   Only the earliest line of each key is looked up, never the pairs of a key.
5. The lines found are compared word by word with the earlier ones before they go.

Edge cases: a null text stays null; lines that are empty or blank stay; rows that repeat
a doc_id share their decisions, by line number; a null doc_id comes last; a document may
be left with an empty text; texts and lines of any length are worked on whole; ties don't
arise, since places are distinct but for rows that repeat a doc_id; other columns, names
like ``line_no`` included, pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LAST = 2**63 - 1
BLANKS = "\t\x0b\f\r"


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc, line_no, line) of every line of ``docs(doc_id, text)``; ``doc`` orders a null doc_id last."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def with_words(lines: DataFrame, least_words: int) -> DataFrame:
    """The lines long enough to count, with their words instead of the text."""
    # blank lines are told by their text, so that the filter doesn't split words once more; few lines hold other blanks
    lines = lines.where(F.trim("line", F.lit(" " + BLANKS)) != "")
    other = reduce(Column.__or__, [F.col("line").contains(b) for b in BLANKS])
    line = F.when(other, F.translate("line", BLANKS, " " * len(BLANKS))).otherwise(F.col("line"))
    out = lines.withColumn("words", F.array_remove(F.split(line, " "), "")).drop("line")
    return out if least_words <= 1 else out.where(F.size("words") >= least_words)


def half_keys() -> Column:
    """(is_last, hash) of the first and last halves that a line can share with one a word longer, shorter or as long."""
    keys = []
    for h in ("div(n, 2)", "div(n - 1, 2)"):
        h = F.expr(f"cast({h} as int)")
        keys += [F.struct(F.lit(False).alias("is_last"), F.xxhash64(F.lit("first"), h, F.slice("words", F.lit(1), h)).alias("half")), F.struct(F.lit(True).alias("is_last"), F.xxhash64(F.lit("last"), h, F.slice("words", F.col("n") - h + 1, h)).alias("half"))]
    return F.array_distinct(F.array(*keys))


def neighbourhood(lines: DataFrame) -> DataFrame:
    """Key rows (k1, k2, pos, doc, line_no) of ``lines(doc, line_no, words, first, last)``: ``pos`` is the word left out, -1 for none.

    Where a line shares only its first half with others, only words after that are left
    out, and the other way round.
    """
    word = lines.select("doc", "line_no", F.size("words").alias("n"), "first", "last", F.posexplode("words").alias("pos", "word"))
    part = lambda seed, shift: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("pos") - shift, "word"), 24)  # noqa: E731  sums of 40-bit values stay in range
    line = W.partitionBy("doc", "line_no")
    before, until = line.orderBy("pos").rowsBetween(W.unboundedPreceding, -1), line.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    word = word.select("doc", "line_no", "n", "first", "last", "pos", *(part(s, d).alias(f"v{s}{d}") for s in (1, 2) for d in (0, 1)))
    sums = [F.sum(f"v{s}0").over(before).alias(f"b{s}") for s in (1, 2)] + [F.sum(f"v{s}1").over(line).alias(f"t{s}") for s in (1, 2)] + [F.sum(f"v{s}1").over(until).alias(f"u{s}") for s in (1, 2)]
    summed = word.select("*", *sums)
    here = F.expr("(first and pos >= div(n - 1, 2)) or (last and pos <= n - 1 - div(n - 1, 2))")
    without = lambda s: F.coalesce(F.col(f"b{s}"), F.lit(0)) + F.col(f"t{s}") - F.col(f"u{s}")
    shorter = summed.where(here).select(without(1).alias("k1"), without(2).alias("k2"), "pos", "doc", "line_no")
    whole = summed.where("pos = n - 1").select((F.coalesce("b1", F.lit(0)) + F.col("v10")).alias("k1"), (F.coalesce("b2", F.lit(0)) + F.col("v20")).alias("k2"), F.lit(-1).alias("pos"), "doc", "line_no")
    return shorter.unionByName(whole)


def within_one(a: str, b: str) -> Column:
    """Are the word arrays ``a`` and ``b`` equal but for one word put in, left out or replaced?"""
    short, long = F.when(F.size(a) <= F.size(b), F.col(a)).otherwise(F.col(b)), F.when(F.size(a) <= F.size(b), F.col(b)).otherwise(F.col(a))
    gap = F.size(long) - F.size(short)
    same = F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda x, y: x == y)
    first = F.array_position(same, F.lit(False)).cast("int")  # from 1, 0 if none
    rest = F.slice(short, F.when(first == 0, 1).otherwise(first), F.size(short)) == F.slice(long, F.when(first == 0, 1).otherwise(first) + 1, F.size(long))
    return F.when(gap == 0, F.size(F.filter(same, lambda x: ~x)) <= 1).when(gap == 1, (first == 0) | rest).otherwise(False)


def dropped_lines(docs: DataFrame, *, edit_from: int = 8) -> DataFrame:
    """(doc, line_no) of every line of ``docs(doc_id, text)`` that goes."""
    docs = docs.select("doc_id", "text")
    lines = with_words(split_lines(docs), 1).withColumn("n", F.size("words"))
    halves = F.when(F.col("n") >= edit_from, half_keys())  # null, so none, for lines that only equal ones can drop
    narrow = common.stored(lines.select("doc", "line_no", F.xxhash64("words").alias("h1"), F.xxhash64("words", F.lit(1)).alias("h2"), halves.alias("halves")))
    first = common.stored(narrow.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line_no")).alias("at"), F.count("*").alias("n")).select("h1", "h2", "at.doc", "at.line_no", "n"))

    # lines that share a half with another line
    half = narrow.select("h1", "h2", F.explode("halves").alias("x")).select("h1", "h2", "x.is_last", "x.half")
    shared = common.stored(half.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half"))
    sides = common.members_of(half, shared, "half").join(shared, "half").groupBy("h1", "h2").agg(F.max(~F.col("is_last")).alias("first"), F.max("is_last").alias("last"))
    near = common.stored(common.members_of(first, sides, "h1", "h2").join(sides, ["h1", "h2"]).select("h1", "h2", "doc", "line_no", "first", "last"))

    # their words, fetched by document and line
    some = common.members_of(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST))), near.select(F.col("doc").alias("doc_id")), "doc_id")
    found = with_words(common.members_of(split_lines(some), near, "doc", "line_no"), edit_from)
    # rows that repeat a doc_id may differ in text: the line must be the one meant
    found = found.withColumn("h1", F.xxhash64("words")).withColumn("h2", F.xxhash64("words", F.lit(1)))
    texts = common.stored(found.join(near, ["doc", "line_no", "h1", "h2"]).dropDuplicates(["h1", "h2"]))
    common.discard(shared, near)

    # keys that meet
    every = common.stored(neighbourhood(texts))
    busy = common.stored(every.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"))
    keys = common.stored(common.members_of(every, busy, "k1", "k2").join(busy, ["k1", "k2"]).select("k1", "k2", "pos", F.struct("doc", "line_no").alias("at")))
    common.discard(every, busy)
    by_place = common.stored(keys.groupBy("k1", "k2", "pos").agg(F.min("at").alias("least"), F.count("*").alias("n")))
    replaced = keys.join(by_place.where("n > 1 and pos >= 0"), ["k1", "k2", "pos"]).select("at", "least")
    by_key = by_place.groupBy("k1", "k2").agg(F.min(F.expr("case when pos < 0 then least end")).alias("whole"), F.min(F.expr("case when pos >= 0 then least end")).alias("cut")).where("whole is not null and cut is not null")
    moved = keys.join(by_key, ["k1", "k2"]).select("at", F.expr("case when pos < 0 then cut else whole end").alias("least"))
    found = replaced.unionByName(moved).where("least < at").groupBy("at").agg(F.min("least").alias("least"))

    # words compared
    mine = texts.select(F.struct("doc", "line_no").alias("at"), "h1", "h2", "words")
    other = texts.select(F.struct("doc", "line_no").alias("least"), F.col("words").alias("other"))
    gone = found.join(mine, "at").join(other, "least").where(within_one("words", "other")).select("h1", "h2")
    state = first.where("n > 1").select("h1", "h2", F.lit(False).alias("gone"), "doc", "line_no").unionByName(gone.select("h1", "h2", F.lit(True).alias("gone"), F.lit(None).cast("bigint").alias("doc"), F.lit(None).cast("int").alias("line_no")))
    state = common.stored(state.groupBy("h1", "h2").agg(F.max("gone").alias("gone"), F.max("doc").alias("first_doc"), F.max("line_no").alias("first_line")))
    common.discard(first, texts, keys, by_place)
    occurs = common.members_of(narrow.select("doc", "line_no", "h1", "h2"), state, "h1", "h2").join(state, ["h1", "h2"])
    out = common.stored(occurs.where("gone or first_doc <> doc or first_line <> line_no").select("doc", "line_no"))
    common.discard(narrow, state)
    return out


def dedup(docs: DataFrame, *, edit_from: int = 8) -> DataFrame:
    """(row, n_lines, n_dropped, text): each row of ``docs`` as a struct, its lines, how many of them go, and the text without those."""
    gone = dropped_lines(docs, edit_from=edit_from).groupBy("doc").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"))
    rows = rows.join(gone.hint("shuffle_hash"), "doc", "left").withColumn("lines", F.split("row.text", "\n"))
    n = F.coalesce(F.when(F.col("row.text").isNotNull(), F.size("lines")), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), "gone")
    same = F.col("gone").isNull() | F.col("row.text").isNull()
    text = F.when(same, F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    left = F.when(same, n).otherwise(F.size(kept))
    return rows.select("row", n.alias("n_lines"), (n - left).alias("n_dropped"), text.alias("text"))


def without_repeats(docs: DataFrame, *, edit_from: int = 8) -> DataFrame:
    """``docs``, all columns, with text (and n_chars, if there) less the dropped lines; documents of which nothing but blanks is left go."""
    out = dedup(docs, edit_from=edit_from).where("n_dropped = 0 or length(trim(text)) > 0")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(new.get(f.name, F.col(f"row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema.fields))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS doc, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc, i - 1 AS line_no, regexp_split_to_array(regexp_replace(ls[i], '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '[ \t\n\x0B\f\r]+') AS w
  FROM (SELECT doc, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), k AS (
  SELECT DISTINCT doc, line_no, w FROM l WHERE w <> ['']
), f AS (
  SELECT w, min((doc, line_no)) AS pl, row_number() OVER () AS id FROM k GROUP BY w
), h AS (
  SELECT DISTINCT id, w, pl, side, n, CASE side WHEN 0 THEN w[1:n] ELSE w[len(w) - n + 1:len(w)] END AS half
  FROM (SELECT *, unnest([len(w) // 2, (len(w) - 1) // 2]) AS n FROM f WHERE len(w) >= 8), (VALUES (0), (1)) AS s(side)
), c AS (
  SELECT DISTINCT a.id, a.w AS aw, b.w AS bw FROM h a JOIN h b ON a.side = b.side AND a.n = b.n AND a.half = b.half AND b.pl < a.pl
), e AS (
  SELECT id, len(aw) AS la, len(bw) AS lb,
    coalesce(list_position(list_transform(range(1, least(len(aw), len(bw)) + 1), lambda i: aw[i] = bw[i]), false), least(len(aw), len(bw)) + 1) - 1 AS head,
    coalesce(list_position(list_transform(range(1, least(len(aw), len(bw)) + 1), lambda i: aw[len(aw) + 1 - i] = bw[len(bw) + 1 - i]), false), least(len(aw), len(bw)) + 1) - 1 AS tail
  FROM c
), g AS (
  SELECT DISTINCT id FROM e WHERE abs(la - lb) <= 1 AND head + tail >= greatest(la, lb) - 1
), x AS (
  SELECT k.doc, list(DISTINCT k.line_no) AS gone FROM k JOIN f ON k.w = f.w
  WHERE f.pl <> (k.doc, k.line_no) OR f.id IN (SELECT id FROM g) GROUP BY k.doc
), o AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls, text, x.gone
  FROM documents LEFT JOIN x ON coalesce(doc_id, 9223372036854775807) = x.doc
)
SELECT doc_id, CAST(len(ls) AS INTEGER) AS n_lines,
  CAST(CASE WHEN gone IS NULL THEN 0 ELSE len(list_filter(range(0, len(ls)), lambda i: list_contains(gone, i))) END AS INTEGER) AS n_dropped,
  md5(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) END, '')) AS text_md5
FROM o
"""
